"""Sinks: Parquet natively, CSV, JSON lines and text files for interchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.merge import filled, keep_first
from ..schemas import TABLES
from . import text_files
from .versions import Table

ORDER = {"quotes": ["symbol", "trade_date"], "report": ["symbol", "date", "url"], "comments": ["symbol", "publish_time", "url"], "news": ["url"]}
#: Limits of the batch service.
REQUESTS_PER_FILE = 50_000
#: Options of master tables.
CSV = {"header": True, "escape": '"', "quote": '"', "emptyValue": "", "nullValue": "", "multiLine": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_csv(df: DataFrame, path: str) -> None:
    """With header and doubled quotes; readers need multiLine and escape='"'."""
    df.write.mode("overwrite").csv(path, header=True, escape='"', quote='"', emptyValue="", nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_dataset(df: DataFrame, path: str, *order: str) -> None:
    """A training set as CSV in its order, each file with a header, lines ending in CR LF (those within values stay)."""
    line = F.to_csv(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"quote": '"', "escape": '"', "emptyValue": "", "nullValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"})
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    rows = df.orderBy(*order).select(F.when(first, F.concat(F.lit(",".join(df.columns) + "\r\n"), line)).otherwise(line).alias("value"))
    rows.write.mode("overwrite").option("lineSep", "\r\n").text(path)


def export_files(files: DataFrame, folder: str) -> None:
    """Write (path, value) as text files under ``folder``, all or none (see ``text_files``)."""
    text_files.write(files, folder)


def write_master(df: DataFrame, path: str, table: str) -> None:
    """A master table as CSV in its order, replaced as a whole: a new version (see ``versions``); ``df`` may read the old."""
    rows = df.select([F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) for f in TABLES[table]]).orderBy(*ORDER[table])
    master(df.sparkSession, path).replace(rows)


def master(spark: SparkSession, path: str) -> Table:
    return Table(spark, path, "csv", **CSV)


def append_master(new: DataFrame, path: str, table: str, *order: str) -> None:
    """New rows behind those of a master table whose order is that of coming (news): the first of each url that it lacks.

    The rows that are there are read for their keys only and not written again; ``master(...).in_order()`` tells which
    rows came together, and within a batch rows are sorted by ``order``, then url.
    """
    known = master(new.sparkSession, path)
    fields = [F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) for f in TABLES[table]]
    fresh, old = keep_first(new.filter(filled(["url"])), ["url"], *order, "url"), known.read()
    if old is not None:
        fresh = fresh.join(old.select("url"), "url", "left_anti")
    known.append(fresh.select(fields).orderBy(*order, "url"))


def init_master(spark: SparkSession, path: str, table: str) -> None:
    master(spark, path).replace(spark.createDataFrame([], ", ".join(f"{f} string" for f in TABLES[table])).coalesce(1))


def request_line(custom_id: Column, model: str, user: Column, system: str | None = None, url: str = "/v1/chat/completions") -> Column:
    """A line of a batch request file."""
    said = [F.struct(F.lit("system").alias("role"), F.lit(system).alias("content"))] if system else []
    messages = F.array(*said, F.struct(F.lit("user").alias("role"), user.alias("content")))
    return F.to_json(F.struct(custom_id.cast("string").alias("custom_id"), F.lit("POST").alias("method"), F.lit(url).alias("url"), F.struct(F.lit(model).alias("model"), messages.alias("messages")).alias("body")))


def write_requests(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").option("maxRecordsPerFile", REQUESTS_PER_FILE).text(path)


def content_text(url: Column, title: Column, day: Column, body: Column, symbol: Column | None = None) -> Column:
    """Text of a content file; titles of news (those with a symbol) are put on one line."""
    head = [F.concat(F.lit("URL="), url)]
    if symbol is not None:
        head.append(F.concat(F.lit("SYMBOL="), symbol))
    head += [F.concat(F.lit("TITLE="), S.one_line(title) if symbol is not None else F.coalesce(title, F.lit(""))), F.concat(F.lit("DATE="), F.coalesce(day.cast("string"), F.lit("")))]
    return F.concat(F.concat_ws("\n", *head), F.lit("\n---\n"), body)


def content_path(kind: str, url: Column, day: Column) -> Column:
    name = F.concat(S.url_key(url), F.lit(".txt"))
    return F.concat(F.lit("news/"), F.date_format(day, "yyyy-MM"), F.lit("/"), name) if kind == "news" else F.concat(F.lit("report/"), name)


def summary_text(metadata: Column, body: Column) -> Column:
    keys = [F.when(F.coalesce(metadata[k], F.lit("")) != "", F.concat(F.lit(f"{k}="), metadata[k])) for k in ("URL", "SYMBOL", "TITLE", "DATE")]
    return F.concat(F.concat_ws("\n", *keys), F.lit("\n---\n"), body)


def write_report(row: DataFrame, path: str) -> None:
    row.coalesce(1).write.mode("overwrite").json(path)
