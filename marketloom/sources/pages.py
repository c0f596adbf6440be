"""Paged services (forums, searches, report lists) as data sources of Spark, for batches and for streams.

    pages.register(spark, "forum", service)
    spark.read.format("forum").option("symbols", "000001,00175").load()          page rows
    spark.readStream.format("forum").option("symbols", "000001").load()          from where the checkpoint stands

A service is a plain object that users bring; nothing here opens a connection by itself:

    total(symbol) -> int | None      how many pages there are now; None if it can't say
    page(symbol, number) -> str      a page as it is sent
    rows(text) -> list[tuple]        its rows as (url, title, snippet, date), as they are written

``HtmlPages`` and ``ForumPages`` are the row parsers of the two kinds.  The driver plans blocks of PAGES_A_TASK pages of a
symbol; each is a task, which asks for its pages in turn, with retries, and stops at one without rows where the total
isn't known.  A stream's offset is the number of pages read of each symbol, so a restart goes on behind them.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..operators.merge import keep_first, stop_after_streak
from .fetch import with_retries

#: Pages of a symbol that are asked for at most, and pages without anything new after which no more are.
MAX_PAGES, STREAK = 50, 3
PAGES_A_TASK = 10
ROWS = StructType([StructField("symbol", StringType()), StructField("page", IntegerType()), StructField("pos", IntegerType()), *(StructField(n, StringType()) for n in ("url", "title", "snippet", "date"))])


class Service(Protocol):
    def total(self, symbol: str) -> int | None: ...

    def page(self, symbol: str, number: int) -> str: ...

    def rows(self, text: str) -> list[tuple]: ...


class HtmlPages:
    """Row parser of news searches and report lists; links are completed by ``base``."""

    def __init__(self, kind: str, base: str = ""):
        self.kind, self.base = kind, base

    def rows(self, text: str) -> list[tuple]:
        from urllib.parse import urljoin

        from ..functions.html import news_rows, report_rows

        read = {"news": news_rows, "report": report_rows}[self.kind]
        return [(urljoin(self.base, url), title, snippet, date) for url, title, snippet, date in read(text or "")]


class ForumPages:
    """Row parser of a forum's pages (JSON in a script's assignment): the post's link, title and time."""

    def __init__(self, base: str):
        self.base = base

    def rows(self, text: str) -> list[tuple]:
        body = text[text.find("{") : text.rfind("}") + 1]
        out = []
        for post in json.loads(body or "{}").get("re") or []:
            link = (post.get("art_unique_url") or "").strip() or f"{self.base}/news,{post.get('stockbar_code')},{post.get('post_id')}.html"
            out.append((link, post.get("post_title"), str(post.get("post_click_count") or ""), post.get("post_publish_time")))
        return out


@dataclass
class Pages(InputPartition):
    symbol: str
    first: int
    last: int
    ends: bool  # whether a page without rows is the end


class Settings:
    """The options of a read."""

    def __init__(self, service: Service, options: dict):
        self.service = service
        self.symbols = list(dict.fromkeys(s.strip() for s in options.get("symbols", "").split(",") if s.strip()))
        self.most, self.block = int(options.get("maxPages", MAX_PAGES)), int(options.get("pagesPerTask", PAGES_A_TASK))
        self.attempts, self.base = int(options.get("attempts", 3)), float(options.get("retrySeconds", 3.0))

    def ask(self, call):
        return with_retries(call, self.attempts, self.base)

    def total(self, symbol: str) -> int | None:
        known = self.ask(lambda: self.service.total(symbol))
        return None if known is None else min(known, self.most)

    def blocks(self, symbol: str, first: int, last: int, ends: bool) -> list[Pages]:
        return [Pages(symbol, at, min(at + self.block - 1, last), ends) for at in range(first, last + 1, self.block)]

    def read(self, part: Pages) -> Iterator[tuple]:
        for number in range(part.first, part.last + 1):
            rows = self.service.rows(self.ask(lambda n=number: self.service.page(part.symbol, n)))
            if not rows and part.ends:
                return
            for pos, (url, title, snippet, date) in enumerate(rows):
                yield part.symbol, number, pos, url, title, snippet, date


class PagesReader(DataSourceReader):
    def __init__(self, settings: Settings):
        self.settings = settings

    def partitions(self) -> list[Pages]:
        out = []
        for symbol in self.settings.symbols:
            total = self.settings.total(symbol)
            out += self.settings.blocks(symbol, 1, self.settings.most if total is None else total, total is None)
        return out or [Pages("", 1, 0, True)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        return self.settings.read(partition)


class PagesStreamReader(DataSourceStreamReader):
    def __init__(self, settings: Settings):
        self.settings = settings

    def initialOffset(self) -> dict:
        return dict.fromkeys(self.settings.symbols, 0)

    def latestOffset(self) -> dict:
        return {s: self.settings.total(s) or 0 for s in self.settings.symbols}

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        return [part for s, last in end.items() for part in self.settings.blocks(s, start.get(s, 0) + 1, last, False)] or [Pages("", 1, 0, True)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        return self.settings.read(partition)


def register(spark: SparkSession, name: str, service: Service) -> None:
    """Make a paged service a format of that name."""

    class PagedSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> StructType:
            return ROWS

        def reader(self, schema: StructType) -> PagesReader:
            return PagesReader(Settings(service, self.options))

        def streamReader(self, schema: StructType) -> PagesStreamReader:
            return PagesStreamReader(Settings(service, self.options))

    spark.dataSource.register(PagedSource)


def listed(rows: DataFrame, streak: int = STREAK, known: DataFrame | None = None) -> DataFrame:
    """Page rows with each (symbol, url) once, where it first stands, up to and with the ``streak``-th page in a row of
    a symbol that has rows, but none whose url is new (neither on the pages before nor in ``known``: symbol, url)."""
    linked = rows.filter("url is not null and trim(url) <> ''")
    first = keep_first(linked, ["symbol", "url"], "page", "pos")
    if known is not None:
        first = first.join(known.select("symbol", "url").distinct(), ["symbol", "url"], "left_anti")
    pages = rows.select("symbol", "page").distinct().join(first.groupBy("symbol", "page").agg(F.count("*").alias("n_new")), ["symbol", "page"], "left")
    kept = stop_after_streak(pages, ["symbol"], "page", F.col("n_new").isNull(), streak)
    return first.join(kept.select("symbol", "page"), ["symbol", "page"], "left_semi").select(rows.columns)


def newest(rows: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` different urls of each symbol in page order."""
    order = Window.partitionBy("symbol").orderBy("page", "pos")
    return listed(rows).withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= limit).drop("_n")
