"""Incremental ingestion: file streams merged by key, with marks of progress in tables.

There is no watermark: late rows must still be merged.  Each micro-batch is one version of the target (see
``sources.versions``), which also holds the batch's number: a batch that is run again after a failure finds itself in the
ledger and changes nothing, one that failed before has left nothing.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.merge import insert_if_absent, update_from, upsert
from ..operators.sampling import ordinal
from ..sources.versions import Files, Table, label


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that Spark keeps for a stream in its checkpoint folder."""
    return json.loads(Files(spark, checkpoint).read("metadata"))["id"]


def merge_batch(table: Table, part: DataFrame, batch: int, stream: str, keys: list[str], mode: str = "insert", order: str | None = None, after: Callable[[DataFrame], DataFrame] | None = None) -> bool:
    """Merge a micro-batch into ``table``; False if the table holds it already.

    Of a split table the parts that the batch touches are read and replaced, all in one version; parts that ``after``
    empties go.
    """
    now = table.current()
    if now and now.ledger.get(stream, -1) >= batch:
        return False
    merge, by = insert_if_absent if mode == "insert" else upsert, [order] if order else keys
    touched = None if table.split is None else [r[0] for r in part.select(label(F.col(table.split))).distinct().collect()]  # as many as the batch has days
    existing = table.read(now, touched) if now else part.limit(0)
    merged = merge(existing, part.select(existing.columns), keys, *by)
    rows = after(merged) if after else merged
    table.commit(rows.select(existing.columns), now, touched, {stream: batch})
    return True


def merge_stream(spark: SparkSession, landing: str, schema: str, target: str, keys: list[str], checkpoint: str, mode: str = "insert", order: str | None = None, after: Callable[[DataFrame], DataFrame] | None = None, partition: str | None = None, files_a_batch: int | None = None, bytes_a_batch: int | None = None):
    """A started stream of Parquet files in ``landing`` into the versioned table ``target``; takes what is there and ends.

    ``mode`` is insert (existing rows win) or upsert (new rows win, the last by ``order``).  ``after`` is applied to
    each merged table (or merged parts), for instance to retain only the top comments.  ``files_a_batch`` and
    ``bytes_a_batch`` bound what is merged, and lost by a failure, at once.

    With ``partition``, a column that a row's keys determine (a day or month), the table is split by it and a batch reads
    and rewrites only the parts it touches.  Without, it rewrites the table: for small tables.
    """

    def merge(part: DataFrame, batch: int) -> None:
        own = part.sparkSession
        merge_batch(Table(own, target, split=partition), part, batch, stream_id(own, checkpoint), keys, mode, order, after)

    stream = spark.readStream.schema(schema)
    for option, value in (("maxFilesPerTrigger", files_a_batch), ("maxBytesPerTrigger", bytes_a_batch)):
        stream = stream.option(option, value) if value else stream
    return stream.parquet(landing).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def flush_updates(updates: DataFrame, table: Table, keys: list[str], column: str, every: int = 50) -> int:
    """Write updates (keys, ``column``) of fetched texts to ``table``, ``every`` rows a version; the number of versions.

    Updates whose text is null failed for now: they stay out and are pending still.  What is fetched is numbered by key
    in a checkpoint, so it is fetched once.  After a failure the versions so far hold what was written; a run over what
    is pending then goes on.
    """
    found = ordinal(updates.filter(F.col(column).isNotNull()).select(*keys, column), keys[0], "_n").withColumn("_flush", F.floor(F.col("_n") / every))
    last = found.agg(F.max("_flush")).first()[0]
    for n in range(0 if last is None else last + 1):
        now = table.current()
        if now is None:
            raise ValueError(f"there is no table at {table.path}")
        table.commit(update_from(table.read(now), found.filter(F.col("_flush") == n), keys, column, "_n"), now)
    return 0 if last is None else last + 1


def high_water(rows: DataFrame, key: str = "symbol", date: str = "trade_date") -> DataFrame:
    return rows.groupBy(key).agg(F.max(date).alias("watermark"))


def fetch_plan(symbols: DataFrame, watermarks: DataFrame, first: str, last: str, ignore_marks: bool = False) -> DataFrame:
    """(symbol, start, end) to fetch: from the day after the mark, or ``first``; done symbols are left out."""
    begin, end = F.to_date(F.lit(first)), F.to_date(F.lit(last))
    start = begin if ignore_marks else F.coalesce(F.date_add("watermark", 1), begin)
    return symbols.join(watermarks, "symbol", "left").select("symbol", start.alias("start"), end.alias("end")).filter("start <= end")


def pending(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return work.join(done, keys, "left_anti")


def pages_done(state: str):
    """Pages named by a mark: a number n (pages 1 to n), a list of pages, or an object with 'completed' of either.

    An object with 'capped_at' has enough rows: all of its 'total_pages' count as done.
    """
    def of(x):
        number, pages = x.try_cast("int"), F.from_json(x, "array<int>")
        return F.when(number.isNotNull(), F.when(number > 0, F.sequence(F.lit(1), number)).otherwise(F.array().cast("array<int>"))).otherwise(F.coalesce(pages, F.array().cast("array<int>")))

    value = F.col(state)
    capped = F.when(F.get_json_object(value, "$.capped_at").isNotNull(), F.get_json_object(value, "$.total_pages"))
    return of(F.coalesce(capped, F.get_json_object(value, "$.completed"), value))


def next_page(state: str, total: str):
    """The smallest page from 1 to ``total`` not done yet, null when all are."""
    left = F.array_except(F.when(F.col(total) > 0, F.sequence(F.lit(1), F.col(total).cast("int"))).otherwise(F.array().cast("array<int>")), pages_done(state))
    return F.array_min(left)


def evicted(rows: DataFrame, fetched: DataFrame, statuses: tuple[str, ...] = ("not_found", "empty")) -> DataFrame:
    """``rows`` without those whose fetch failed for good."""
    return rows.join(fetched.filter(F.col("status").isin(*statuses)), "url", "left_anti")
