"""The engine's tables as views of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of each user of events."""
    at = F.struct("ts", "event_id")
    days = table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("symbol"), F.to_date("ts").alias("trade_date")).agg(
        F.min_by("value", at).alias("open"), F.max_by("value", at).alias("close"), F.max("value").alias("high"), F.min("value").alias("low"), F.count("*").cast("double").alias("volume"), F.sum("value").alias("amount")
    )
    before = F.nullif(F.lag("close").over(Window.partitionBy("symbol").orderBy("trade_date")), F.lit(0.0))
    days = days.withColumns({"_before": before, "_total": F.sum("volume").over(Window.partitionBy("symbol"))})
    change = F.col("close") - F.col("_before")
    return days.withColumns({"change_amount": change, "pct_change": 100 * change / F.col("_before"), "amplitude": 100 * (F.col("high") - F.col("low")) / F.col("_before"), "turnover": 100 * F.col("volume") / F.col("_total")}).drop("_before", "_total")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated items: orders by their customer's nation."""
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(F.col("c_nationkey").cast("string").alias("symbol"), F.to_date("o_orderdate").alias("item_date"), F.col("o_orderkey").cast("string").alias("url"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("summary"))


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    market = F.when(F.col("n_nationkey") % 7 == 0, "hk").otherwise("a")
    return joined.select(F.col("r_name").alias("sector"), F.col("n_name").alias("name"), F.col("n_nationkey").cast("string").alias("symbol"), market.alias("market"), F.col("r_regionkey").alias("sector_pos"), F.col("n_nationkey").alias("pos"))


#: The same views in DuckDB's SQL, as common table expressions.
BARS_SQL = """g AS (SELECT CAST(user_id AS VARCHAR) AS symbol, CAST(ts AS DATE) AS trade_date, first(value ORDER BY ts, event_id) AS open, last(value ORDER BY ts, event_id) AS close, max(value) AS high, min(value) AS low, CAST(count(*) AS DOUBLE) AS volume, sum(value) AS amount FROM events GROUP BY 1, 2),
bars AS (SELECT * EXCLUDE (prev, total), close - prev AS change_amount, 100 * (close - prev) / prev AS pct_change, 100 * (high - low) / prev AS amplitude, 100 * volume / total AS turnover FROM (SELECT *, nullif(lag(close) OVER (PARTITION BY symbol ORDER BY trade_date), 0) AS prev, sum(volume) OVER (PARTITION BY symbol) AS total FROM g))"""
ITEMS_SQL = """items AS (SELECT CAST(c_nationkey AS VARCHAR) AS symbol, CAST(o_orderdate AS DATE) AS item_date, CAST(o_orderkey AS VARCHAR) AS url, o_orderpriority AS title, o_orderstatus AS summary FROM orders JOIN customer ON o_custkey = c_custkey)"""
