"""Vendors of daily bars as a data source, for batches and for streams that fetch what is new.

    vendor.register(spark, "bars", service)
    spark.read.format("bars").option("symbols", "000001:a,00175:hk").option("start", "2026-01-01").option("end", "2026-03-31").load()
    spark.readStream.format("bars").option("symbols", "000001:a").option("start", "2026-01-01").load()

A service is a plain object that users bring:

    bars(endpoint, symbol, start, end) -> list[dict]    unadjusted bars of the days from start to end (yyyy-MM-dd), with the
                                                        vendor's own names of columns; endpoint is that of the market
    today() -> str                                      the last day that is complete (streams only)

Each symbol and YEARS_A_TASK years are a task, which asks with retries.  A stream's offset is the day up to which all symbols
have been fetched; the next batch begins the day after, so a restart neither repeats nor skips days.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, timedelta
from typing import Protocol

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

from ..schemas import QUOTE_ALIASES, QUOTES, QUOTES_REQUIRED
from .fetch import with_retries

#: A market's service.
ENDPOINTS = {"a": "stock_zh_a_hist", "hk": "stock_hk_hist"}
YEARS_A_TASK = 5
BARS = StructType([StructField(n, StringType()) for n in QUOTES])


class Service(Protocol):
    def bars(self, endpoint: str, symbol: str, start: str, end: str) -> list[dict]: ...

    def today(self) -> str: ...


@dataclass
class Days(InputPartition):
    symbol: str
    market: str
    start: str
    end: str


class Settings:
    """The options of a read."""

    def __init__(self, service: Service, options: dict):
        self.service = service
        pairs = (s.strip().partition(":") for s in options.get("symbols", "").split(",") if s.strip())
        self.symbols = {symbol: market or "a" for symbol, _, market in pairs}
        if unknown := set(self.symbols.values()) - set(ENDPOINTS):
            raise ValueError(f"no vendor for market {', '.join(sorted(unknown))}")
        self.start, self.end = options.get("start", "1990-01-01"), options.get("end")
        self.attempts, self.base = int(options.get("attempts", 3)), float(options.get("retrySeconds", 3.0))

    def parts(self, start: str, end: str) -> list[Days]:
        out, first, last = [], date.fromisoformat(start), date.fromisoformat(end)
        while first <= last:
            upto = min(last, date(first.year + YEARS_A_TASK - 1, 12, 31))
            out += [Days(s, m, first.isoformat(), upto.isoformat()) for s, m in self.symbols.items()]
            first = upto + timedelta(1)
        return out or [Days("", "a", "", "")]

    def read(self, part: Days) -> Iterator[tuple]:
        if not part.symbol:
            return
        for row in with_retries(lambda: self.service.bars(ENDPOINTS[part.market], part.symbol, part.start, part.end), self.attempts, self.base):
            found = {n: next((row[a] for a in aliases if a in row), None) for n, aliases in QUOTE_ALIASES.items()}
            if missing := [n for n in QUOTES_REQUIRED if found[n] is None and not any(a in row for a in QUOTE_ALIASES[n])]:
                raise ValueError(f"the vendor's row lacks {', '.join(missing)}; it has {', '.join(row)}")
            yield part.symbol, *(None if found[n] is None else str(found[n]) for n in QUOTES[1:])


class BarsReader(DataSourceReader):
    def __init__(self, settings: Settings):
        self.settings = settings

    def partitions(self) -> list[Days]:
        if not self.settings.end:
            raise ValueError("a batch needs an end")
        return self.settings.parts(self.settings.start, self.settings.end)

    def read(self, partition: Days) -> Iterator[tuple]:
        return self.settings.read(partition)


class BarsStreamReader(DataSourceStreamReader):
    def __init__(self, settings: Settings):
        self.settings = settings

    def initialOffset(self) -> dict:
        return {"done": (date.fromisoformat(self.settings.start) - timedelta(1)).isoformat()}

    def latestOffset(self) -> dict:
        today = with_retries(lambda: self.settings.service.today(), self.settings.attempts, self.settings.base)
        last = min(today, self.settings.end or today)
        return {"done": max(last, self.initialOffset()["done"])}

    def partitions(self, start: dict, end: dict) -> list[Days]:
        return self.settings.parts((date.fromisoformat(start["done"]) + timedelta(1)).isoformat(), end["done"])

    def read(self, partition: Days) -> Iterator[tuple]:
        return self.settings.read(partition)


def register(spark: SparkSession, name: str, service: Service) -> None:
    """Make a vendor a format of that name; its rows are quotes as text (see ``readers.typed_quotes``)."""

    class VendorSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> StructType:
            return BARS

        def reader(self, schema: StructType) -> BarsReader:
            return BarsReader(Settings(service, self.options))

        def streamReader(self, schema: StructType) -> BarsStreamReader:
            return BarsStreamReader(Settings(service, self.options))

    spark.dataSource.register(VendorSource)
