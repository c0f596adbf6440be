"""Marks of progress: pages done by company, items done by platform.

A company's mark is a number n (pages 1 to n), a list of pages, or an object with 'total_pages' and 'completed' (either
of the two) and, where enough rows were read, 'capped_at'.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.versions import Table
from .incremental import pages_done

#: Rows of a company after which no more pages are asked for.
CAP = 10_000


def total_pages(state: str) -> Column:
    """The number of pages that a mark knows of, null if it doesn't."""
    value = F.col(state)
    return F.coalesce(value.try_cast("int"), F.get_json_object(value, "$.total_pages").try_cast("int"), F.get_json_object(value, "$.completed").try_cast("int"))


def compacted(marks: DataFrame) -> DataFrame:
    """(company, state) in one form: a number if all pages are done, else an object with sorted pages."""
    done, total = F.array_sort(F.array_distinct(pages_done("state"))), total_pages("state")
    whole = total.isNotNull() & (F.size(F.array_except(F.sequence(F.lit(1), F.greatest(total, F.lit(1))), done)) == 0)
    partly = F.to_json(F.struct(F.coalesce(total, F.lit(1)).alias("total_pages"), done.alias("completed")))
    capped = F.get_json_object("state", "$.capped_at").isNotNull()
    return marks.select("company", F.when(capped, F.col("state")).when(whole, total.cast("string")).otherwise(partly).alias("state"))


def with_pages(marks: DataFrame, done: DataFrame) -> DataFrame:
    """Marks after more pages (company, page) are done, in one form."""
    more = done.groupBy("company").agg(F.collect_set("page").alias("_more"))
    both = marks.join(more, "company", "full")
    pages = F.array_sort(F.array_union(F.coalesce(pages_done("state"), F.array().cast("array<int>")), F.coalesce("_more", F.array().cast("array<int>"))))
    capped = F.get_json_object("state", "$.capped_at").isNotNull()
    total = F.coalesce(total_pages("state"), F.lit(1))
    return compacted(both.select("company", F.when(capped, F.col("state")).otherwise(F.to_json(F.struct(total.alias("total_pages"), pages.alias("completed")))).alias("state")))


def pages_to_fetch(marks: DataFrame, saved: DataFrame, cap: int = CAP, use_marks: bool = True) -> DataFrame:
    """(company, page) still to be fetched of companies (company, total, state), but of none whose rows ``saved``
    (company, n_rows) have reached the cap."""
    pages = F.when(F.col("total") > 0, F.sequence(F.lit(1), F.col("total").cast("int"))).otherwise(F.array().cast("array<int>"))
    left = F.array_except(pages, pages_done("state")) if use_marks else pages
    open_ = marks.join(saved.filter(F.col("n_rows") >= cap), "company", "left_anti")
    return open_.select("company", F.explode(left).alias("page"))


def capped_marks(marks: DataFrame, saved: DataFrame, cap: int = CAP) -> DataFrame:
    """Marks of companies whose rows have reached the cap name it, so that they count as done."""
    full = saved.filter(F.col("n_rows") >= cap).select("company", F.lit(True).alias("_full"))
    state = F.to_json(F.struct(total_pages("state").alias("total_pages"), pages_done("state").alias("completed"), F.lit(cap).alias("capped_at")))
    return marks.join(full, "company", "left").select("company", F.when(F.col("_full") & total_pages("state").isNotNull(), state).otherwise(F.col("state")).alias("state"))


def write_marks(marks: DataFrame, path: str) -> None:
    """The marks of all companies, sorted, as the next version of their table."""
    Table(marks.sparkSession, path, "json").replace(marks.select("company", "state").orderBy("company"))


def read_marks(spark: SparkSession, path: str, use_marks: bool = True) -> DataFrame:
    """(company, state); none if they aren't to be used or were never written."""
    known = Table(spark, path, "json").read() if use_marks else None
    return spark.createDataFrame([], "company string, state string") if known is None else known


def completed(done: DataFrame, platform: str) -> DataFrame:
    """One row: the items done on a platform, sorted."""
    return done.filter(F.col("platform") == platform).agg(F.array_sort(F.collect_set("item")).alias("items")).select(F.lit(platform).alias("platform"), "items")
