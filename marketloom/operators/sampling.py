"""Reproducible samples and splits: by a hash of the id, so they don't depend on partitioning."""

from __future__ import annotations

from math import ceil, gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def hash_order(key: str | Column, seed: int = 42) -> Column:
    return F.xxhash64(F.col(key) if isinstance(key, str) else key, F.lit(seed))


def nth_key(df: DataFrame, key: Column, n: int):
    """The ``n``-th smallest (from 1) value of ``key``, nulls first; (value, how many rows there are if fewer than ``n``).

    Keys alone are sorted in ranges (by splitters that Spark samples) and counted a range; the one that holds the n-th is
    looked into.  No task, and not the driver, sees more than a range.
    """
    ensure_checkpoint_dir(df.sparkSession)
    place = F.monotonically_increasing_id()
    held = df.select(key.alias("k")).orderBy(F.asc_nulls_first("k")).withColumns({"part": F.shiftright(place, 33), "within": place.bitwiseAND(F.lit((1 << 33) - 1))}).checkpoint()
    before = 0
    for r in sorted(held.groupBy("part").count().collect()):  # a row a range
        if before + r["count"] >= n:
            return held.filter((F.col("part") == r["part"]) & (F.col("within") == n - before - 1)).first()["k"], None
        before += r["count"]
    return None, before


def sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows (all, if there are fewer), by a hash of their key: those under the n-th hash."""
    if n <= 0:
        return df.limit(0)
    hashed = hash_order(key, seed)
    last, fewer = nth_key(df, hashed, n)
    # Keys of one hash are so rare that a top list has only those of the last.
    return df if fewer is not None else df.filter(hashed < last).unionByName(df.filter(hashed == last).orderBy(key).limit(n - df.filter(hashed < last).count()))


def step_sample(df: DataFrame, key: str, n: int, step: int, seed: int = 42) -> DataFrame:
    """The evaluation subset of a training step."""
    return sample(df, key, n, seed * 1_000_003 + step)


def split(df: DataFrame, key: str, ratio: float = 0.01, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(training, evaluation) rows."""
    held = F.pmod(hash_order(key, seed), F.lit(1_000_000)) < int(ratio * 1_000_000)
    return df.filter(~held), df.filter(held)


def first_rows(df: DataFrame, key: str, n: int | None) -> DataFrame:
    """The first ``n`` rows in key order; all without ``n``."""
    return df if n is None else df.orderBy(key).limit(n)


def subset_size(n: int, ratio: float) -> int:
    return min(max(ceil(n * ratio), 1), n)


def auto_ratio(eval_steps: int, n_train: int) -> float:
    return min(1.0, 2 * eval_steps / n_train)


def fitted_batch(workers: int, generations: int, wanted: int) -> int:
    """The smallest batch of a worker, ``wanted`` or more, for which all workers' rows divide into groups of generations."""
    step = generations // gcd(workers, generations) if workers > 0 and generations > 1 else 1
    return step * ceil(max(wanted, 1) / step)


def numbered(df: DataFrame, key: str, offset: int, limit: int | None, valid: Column) -> DataFrame:
    """Rows past ``offset`` in key order, of these the first ``limit`` valid ones, in key order.

    The offset counts all rows, the limit only valid ones.  Keys are unique; rows without one come first.  Both ends are
    found as the n-th key (see ``nth_key``); no top list grows with them.
    """
    rest = df
    if offset > 0:
        last, fewer = nth_key(df, F.col(key), offset)
        if fewer is not None:
            return df.limit(0)
        rest = df.filter(F.col(key).isNotNull() if last is None else F.col(key) > F.lit(last))
    rest = rest.filter(valid)
    if limit is not None:
        if limit <= 0:
            return df.limit(0)
        last, fewer = nth_key(rest, F.col(key), limit)
        if fewer is None:
            rest = rest.filter(F.col(key).isNull() if last is None else F.col(key).isNull() | (F.col(key) <= F.lit(last)))
    return rest.orderBy(F.asc_nulls_first(key))


def ordinal(df: DataFrame, key: str, name: str = "i") -> DataFrame:
    """``df`` with each row's number in key order, from 0.

    Rows are sorted in ranges of the key, numbered within their partition and moved by the rows of the partitions
    before, so no task sees all rows.  The sorted rows are checkpointed: their partitions must not change in between.
    """
    ensure_checkpoint_dir(df.sparkSession)
    place = F.monotonically_increasing_id()
    held = df.orderBy(key).withColumns({"_part": F.shiftright(place, 33), "_within": place.bitwiseAND(F.lit((1 << 33) - 1))}).checkpoint()
    sizes = held.groupBy("_part").agg(F.count("*").alias("_n"))  # a row a partition
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_before")
    return held.join(F.broadcast(before), "_part").select(*df.columns, (F.col("_before") + F.col("_within")).alias(name))
