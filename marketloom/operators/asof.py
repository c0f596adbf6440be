"""As-of joins of dated items to a grid of (symbol, day)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .merge import top_per_group


def topk_asof(grid: DataFrame, items: DataFrame, k: int, max_age_days: int | None = None, strict: bool = False) -> DataFrame:
    """``grid`` (symbol, day, ...) with ``items``: the ``k`` newest items up to the day, newest first.

    ``items`` has symbol, item_date, url and more; ties in date go by url, descending.  Days without items get an
    empty array.  ``max_age_days`` bounds the age (both ends inclusive), ``strict`` leaves out the day itself.

    No range join, and no window over a symbol's items.  Of a symbol's day only the last ``k`` items can be wanted (cut
    within tasks before the shuffle).  The rest is a scan in two levels: in each block (symbol, month) an item carries
    its ``k - 1`` predecessors there and each day takes the array of the last item before it; what a block's days lack
    comes from the blocks before, of which each has its last ``k`` items.  A block holds a month's days, whatever the
    number of items; a symbol's blocks are as many as its months.
    """
    fields = ["item_date", "url", *[c for c in items.columns if c not in ("symbol", "item_date", "url")]]
    month = lambda day: F.trunc(day, "month")
    dated = top_per_group(items.filter("symbol is not null and item_date is not null"), ["symbol", "item_date"], k, F.desc_nulls_last("url")).withColumn("_block", month(F.col("item_date")))
    by_date = Window.partitionBy("symbol", "_block").orderBy("item_date", "url")
    newest = F.reverse(F.collect_list(F.struct(*fields)).over(by_date.rowsBetween(-(k - 1), 0)))
    carried = dated.select("symbol", "_block", F.col("item_date").alias("_day"), F.lit(1 if strict else 0).alias("_kind"), newest.alias("_items"), F.col("url").alias("_url"))
    kind = carried.schema["_items"].dataType
    none = F.array().cast(kind)

    # The last k items up to the end of each block, then up to its beginning.
    ends = carried.groupBy("symbol", "_block").agg(F.max_by("_items", F.struct("_day", "_url")).alias("_tail"))
    blocks = Window.partitionBy("symbol").orderBy("_block")
    upto = F.slice(F.flatten(F.reverse(F.collect_list("_tail").over(blocks.rowsBetween(-(k - 1), 0)))), 1, k)
    wanted = grid.select("symbol", month(F.col("day")).alias("_block"), F.lit(None).cast(kind).alias("_upto")).filter("symbol is not null and _block is not null").distinct()
    known = ends.select("symbol", "_block", upto.alias("_upto")).unionByName(wanted).groupBy("symbol", "_block").agg(F.first("_upto", ignorenulls=True).alias("_upto"))
    before = known.select("symbol", "_block", F.last("_upto", ignorenulls=True).over(blocks.rowsBetween(Window.unboundedPreceding, -1)).alias("_before")).filter("_before is not null")

    cells = grid.withColumns({"_block": month(F.col("day")), "_day": F.col("day"), "_kind": F.lit(0 if strict else 1), "_items": F.lit(None).cast(kind), "_url": F.lit(None).cast(carried.schema["_url"].dataType)})
    merged = carried.unionByName(cells, allowMissingColumns=True)
    order = Window.partitionBy("symbol", "_block").orderBy("_day", "_kind", "_url").rowsBetween(Window.unboundedPreceding, 0)
    found = merged.withColumn("_within", F.last("_items", ignorenulls=True).over(order)).filter(F.col("_kind") == (0 if strict else 1))
    kept = F.slice(F.concat(F.coalesce("_within", none), F.coalesce("_before", none)), 1, k)
    if max_age_days is not None:
        kept = F.filter(kept, lambda x: x["item_date"] >= F.date_sub(F.col("day"), max_age_days))
    return found.join(before, ["symbol", "_block"], "left").select(*grid.columns, kept.alias("items"))


def calendar_grid(symbols: DataFrame, start: str, end: str) -> DataFrame:
    """Every symbol on every calendar day from start to end, both included."""
    days = F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)), F.expr("interval 1 day"))
    return symbols.select("symbol", F.explode(days).alias("day"))
