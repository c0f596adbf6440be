"""Retention of the top comments of each symbol and day, kept up to date by micro-batches.

Beside the table of comments (split by day) stands a table of floors: of each (symbol, day) that is full, the last row
kept.  A new row that comes behind its floor can't be kept and goes before the merge; only days that still have new rows
are read and written.  The result is that of merging everything and trimming the whole table.

A floor's version names the version of the comments that it belongs to.  If a driver dies between the two commits, the next
batch finds that they don't belong together and takes the floors anew from the comments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.merge import filled, keep_first, merge_comments
from ..sources.versions import Table, Version, label

OF = "comments"
#: Fixed value: comments of a symbol and day that are kept.
KEPT = 200


def clicks(of: str = "click_count") -> Column:
    return S.truncated_int(F.col(of))


def floors_of(comments: DataFrame, n: int) -> DataFrame:
    """(symbol, day, clicks, url, post_id) of the ``n``-th comment of each full (symbol, day)."""
    order = Window.partitionBy("symbol", "day").orderBy(F.desc("clicks"), "url", "post_id")
    ranked = comments.select("symbol", "day", clicks().alias("clicks"), "url", "post_id").withColumn("_r", F.row_number().over(order))
    return ranked.filter(F.col("_r") == n).drop("_r")


def above(new: DataFrame, floors: DataFrame) -> DataFrame:
    """New rows that come before the floor of their (symbol, day), or whose day isn't full."""
    f = floors.select(F.col("symbol").alias("_s"), F.col("day").alias("_d"), F.struct((-F.col("clicks")).alias("c"), "url", "post_id").alias("_floor"))
    own = F.struct((-clicks()).alias("c"), F.col("url"), F.col("post_id"))
    joined = new.join(f, new["symbol"].eqNullSafe(f["_s"]) & (new["day"] == f["_d"]), "left")
    return joined.filter(F.col("_floor").isNull() | (own < F.col("_floor"))).select(new.columns)


def tables(spark, path: str) -> tuple[Table, Table]:
    """The comments and their floors."""
    return Table(spark, f"{path}/comments", split="day"), Table(spark, f"{path}/floors", split="day")


def current_floors(comments: Table, floors: Table, now: Version | None, n: int) -> tuple[DataFrame, Version | None] | None:
    """The floors of the comments' version ``now``, and the version that holds them; taken anew if none does."""
    if now is None:
        return None
    held = floors.current()
    if held is None or held.ledger.get(OF) != now.number:
        held = floors.commit(floors_of(comments.read(now), n), held, None, {OF: now.number})
    return floors.read(held), held


def retain_batch(comments: Table, floors: Table, part: DataFrame, batch: int, stream: str, n: int = KEPT) -> list[str]:
    """Merge new comments (url, post_id, symbol, publish_time, click_count and more); the parts that were rewritten.

    A url's comment has one publish_time, so it is looked for in its own day only.
    """
    now = comments.current()
    if now and now.ledger.get(stream, -1) >= batch:
        return []
    fresh = keep_first(part.filter(filled(["url"])), ["url"], "url", "post_id").withColumn("day", S.calendar_day(F.col("publish_time")))
    known = current_floors(comments, floors, now, n)
    if known:
        fresh = above(fresh, known[0])
    touched = [r[0] for r in fresh.select(label(F.col("day"))).distinct().collect()]  # as many as the batch has days
    if now is not None and not touched:
        return []
    existing = comments.read(now, touched) if now else fresh.limit(0)
    rows = merge_comments(existing, fresh.select(existing.columns), n)
    after = comments.commit(rows, now, touched if now else None, {stream: batch})
    new_floors = floors_of(comments.read(after, touched), n)
    floors.commit(new_floors, known[1] if known else floors.current(), touched if known else None, {OF: after.number})
    return touched


def retain_stream(spark, landing: str, schema: str, path: str, checkpoint: str, n: int = KEPT, files_a_batch: int | None = None):
    """A started stream of Parquet files of comments into the tables at ``path``; takes what is there and ends."""
    from .incremental import stream_id

    def merge(part: DataFrame, batch: int) -> None:
        part = part.persist()
        try:
            retain_batch(*tables(part.sparkSession, path), part, batch, stream_id(part.sparkSession, checkpoint), n)
        finally:
            part.unpersist()

    stream = spark.readStream.schema(schema)
    stream = stream.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else stream
    return stream.parquet(landing).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
