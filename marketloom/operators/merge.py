"""Keyed merges.  Keep-first and last-wins go by an explicit order, never by row order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def filled(keys: list[str]) -> Column:
    """Whether no key is null or blank."""
    out = F.lit(True)
    for k in keys:
        out &= F.col(k).isNotNull() & (F.trim(F.col(k).cast("string")) != "")
    return out


def keep_first(df: DataFrame, keys: list[str], *order: str | Column) -> DataFrame:
    """The first row of each key in the given order."""
    first = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_first", F.row_number().over(first)).filter("_first = 1").drop("_first")


def insert_if_absent(existing: DataFrame, new: DataFrame, keys: list[str], *order: str | Column) -> DataFrame:
    """``existing`` and those new rows whose key it lacks (the first of each key)."""
    fresh = keep_first(new.filter(filled(keys)), keys, *order).join(existing.select(*keys), keys, "left_anti")
    return existing.unionByName(fresh.select(*existing.columns))


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], *order: str | Column) -> DataFrame:
    """New rows replace existing ones; of new rows with one key the last in the order wins."""
    last = Window.partitionBy(*keys).orderBy(*[(F.col(o) if isinstance(o, str) else o).desc() for o in order])
    wins = new.filter(filled(keys)).withColumn("_last", F.row_number().over(last)).filter("_last = 1").select(*existing.columns)
    return existing.join(wins.select(*keys), keys, "left_anti").select(*existing.columns).unionByName(wins)


def delete_by_key(existing: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return existing.join(gone.select(*keys).distinct(), keys, "left_anti")


def update_from(existing: DataFrame, updates: DataFrame, keys: list[str], column: str, *order: str | Column) -> DataFrame:
    """``column`` overwritten where an update has the key, even by an empty text; the last update in the order wins."""
    last = Window.partitionBy(*keys).orderBy(*[(F.col(o) if isinstance(o, str) else o).desc() for o in order])
    one = updates.withColumn("_last", F.row_number().over(last)).filter("_last = 1").select(*keys, F.col(column).alias("_new"), F.lit(True).alias("_hit"))
    value = F.when(F.col("_hit"), F.col("_new")).otherwise(F.col(column))
    return existing.join(one, keys, "left").withColumn(column, value).select(*existing.columns)


def top_per_group(df: DataFrame, groups: list[str | Column], n: int, *order: str | Column) -> DataFrame:
    """The first ``n`` rows of each group.  Spark filters within tasks before the shuffle (window group limit)."""
    ranked = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(ranked)).filter(F.col("_rank") <= n).drop("_rank")


def retain_comments(comments: DataFrame, n: int = 200) -> DataFrame:
    """At most ``n`` comments a symbol and day, by clicks; times that can't be read share one day."""
    from ..functions.scalars import calendar_day, truncated_int

    day = calendar_day(F.col("publish_time"))
    return top_per_group(comments, ["symbol", day], n, truncated_int(F.col("click_count")).desc(), "url", "post_id")


def merge_comments(existing: DataFrame, new: DataFrame, n: int = 200) -> DataFrame:
    return retain_comments(insert_if_absent(existing, new, ["url"], "url", "post_id"), n)


def merge_counts(before: DataFrame, after: DataFrame) -> dict[str, int]:
    old, now = before.count(), after.count()
    return {"before": old, "after": now, "added": max(now - old, 0), "deleted": max(old - now, 0)}


def union_capped(parts: list[DataFrame], key: str, cap: int, groups: list[str], order: str) -> DataFrame:
    """Sources one after the other, each key once (from the first source that has it), at most ``cap`` a group."""
    merged = None
    for i, part in enumerate(parts):
        part = part.withColumn("_source", F.lit(i))
        merged = part if merged is None else merged.unionByName(part)
    return top_per_group(keep_first(merged, [*groups, key], "_source", order), groups, cap, "_source", order, key).drop("_source")


def stop_after_streak(df: DataFrame, groups: list[str], order: str, counts: Column, streak: int) -> DataFrame:
    """Rows up to and with the one that completes the first run of ``streak`` rows for which ``counts`` holds.

    Rows where it doesn't hold (or is null) start the run anew.

    A scan in two levels, so that a large group is the work of many tasks: rows are dealt by ranges of (group, order), and
    what a task has of a group is a block.  A block's summary (its first hits until a miss, its last hits since one, its
    own first run) tells, with the hits before it, where the run is completed; summaries are combined along a group's
    blocks, of which there are as many as tasks at most.  The dealt rows are checkpointed: blocks must not change.
    """
    ensure_checkpoint_dir(df.sparkSession)
    rows = df.withColumn("_hit", F.coalesce(counts, F.lit(False))).repartitionByRange(*groups, order).sortWithinPartitions(*groups, order)
    held = rows.withColumn("_at", F.monotonically_increasing_id()).withColumn("_block", F.shiftright("_at", 33)).checkpoint()
    own = [*groups, "_block"]

    in_block = Window.partitionBy(*own).orderBy("_at")
    # The last miss before a row of the block; hits since then are its run.
    missed = F.max(F.when(~F.col("_hit"), F.col("_at"))).over(in_block.rowsBetween(Window.unboundedPreceding, 0))
    first = F.min("_at").over(Window.partitionBy(*own))
    runs = held.select(*own, "_at", "_hit", missed.alias("_missed"), first.alias("_first")).withColumn("_run", F.col("_at") - F.coalesce("_missed", F.col("_first") - 1))
    leading = F.col("_hit") & F.col("_missed").isNull()
    blocks = runs.groupBy(*own).agg(
        F.min("_at").alias("_begins"), F.count_if(leading).alias("_leading"), F.max("_missed").isNotNull().alias("_broken"),
        F.max_by("_run", "_at").alias("_trailing"), F.min(F.when(F.col("_hit") & (F.col("_run") >= streak), F.col("_at"))).alias("_inside"),
    )
    along = Window.partitionBy(*groups).orderBy("_block")
    since = blocks.withColumn("_piece", F.sum(F.col("_broken").cast("int")).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    ends = since.withColumn("_ends", F.sum("_trailing").over(Window.partitionBy(*groups, "_piece").orderBy("_block").rowsBetween(Window.unboundedPreceding, 0)))
    lacking = F.greatest(streak - F.coalesce(F.lag("_ends").over(along), F.lit(0)), F.lit(1))
    across = F.when(F.col("_leading") >= lacking, F.col("_begins") + lacking - 1)
    stops = ends.withColumn("_stop", F.least(across, "_inside")).withColumn("_stop", F.min("_stop").over(Window.partitionBy(*groups))).filter("_stop is not null").select(*own, "_stop")
    same = F.lit(True)
    for c in own:
        same &= F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}"))
    joined = held.alias("r").join(stops.alias("s"), same, "left").filter(F.col("_stop").isNull() | (F.col("_at") <= F.col("_stop")))
    return joined.select(*[F.col(f"r.`{c}`") for c in df.columns])
