"""Scans in two levels against plain loops, with one group that holds most of the rows."""

import random
from collections import defaultdict
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from marketloom.operators import asof, merge, sampling


@pytest.fixture
def uncoalesced(spark):
    """Small tables stay in as many tasks as large ones would."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("k,age,strict", [(1, None, False), (3, None, True), (7, 45, False), (7, 45, True)])
def test_asof_across_months(spark, k, age, strict):
    rng = random.Random(k)
    first = date(2025, 11, 20)
    items = [(rng.choice(["hot"] * 8 + ["a", None]), first + timedelta(rng.choice([0, 3, 3, 40, 41, 42, 75, 160, rng.randrange(200)])), f"u{i:04}", i) for i in range(400)]
    items += [("late", date(2026, 9, 9), "u", 1), ("hot", None, "v", 1)]
    grid = [(s, first + timedelta(d), d) for s in ("hot", "a", "none", "late") for d in range(-40, 260, 7)] + [(None, first, 0), ("hot", None, 0)]
    got = asof.topk_asof(spark.createDataFrame(grid, "symbol string, day date, d int"), spark.createDataFrame(items, "symbol string, item_date date, url string, x int"), k, age, strict).collect()
    assert len(got) == len(grid)
    for r in got:
        fine = [(d, u, x) for s, d, u, x in items if r["symbol"] is not None and r["day"] and s == r["symbol"] and d and (d < r["day"] if strict else d <= r["day"])]
        newest = [x for x in sorted(fine, reverse=True)[:k] if age is None or x[0] >= r["day"] - timedelta(age)]
        assert [tuple(x) for x in r["items"]] == newest


def test_asof_of_one_symbol_is_the_work_of_many_tasks(uncoalesced):
    spark = uncoalesced
    items = spark.range(40_000).select(F.lit("one").alias("symbol"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 1500).cast("int")).alias("item_date"), F.format_string("u%06d", "id").alias("url"))
    grid = asof.calendar_grid(spark.createDataFrame([("one",)], "symbol string"), "2020-01-01", "2024-06-01")
    out = asof.topk_asof(grid, items, 10)
    dealt = out.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("count"), F.sum(F.size("items")).alias("found")).collect()
    assert len(dealt) == 4 and max(r["count"] for r in dealt) < 0.5 * sum(r["count"] for r in dealt)
    last = out.filter("day = date'2020-01-03'").first()["items"]
    assert [x["url"] for x in last] == [f"u{2 + 1500 * i:06}" for i in range(26, 16, -1)]


def plain_stop(rows, streak):
    """Rows (group, order, hit), kept up to the first completed streak."""
    groups, out = defaultdict(list), []
    for r in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        groups[r[0]].append(r)
    for own in groups.values():
        run = 0
        for r in own:
            out.append(r)
            run = run + 1 if r[2] else 0
            if run >= streak:
                break
    return sorted(out, key=str)


@pytest.mark.parametrize("streak", [1, 3, 60, 500])
def test_streaks_across_blocks(uncoalesced, streak):
    rng = random.Random(streak)
    rows = []
    for group, n, p in (("hot", 900, 0.5), ("runs", 700, 0.97), ("all", 600, 1.0), (None, 40, 0.6), ("none", 20, 0.0), ("one", 1, 1.0)):
        rows += [(group, i, None if rng.random() < 0.02 and p < 1 else rng.random() < p) for i in range(n)]
    rng.shuffle(rows)
    df = uncoalesced.createDataFrame(rows, "g string, o int, hit boolean").withColumn("_block2", F.lit(1))
    out = merge.stop_after_streak(df, ["g"], "o", F.col("hit"), streak)
    assert out.columns == df.columns and sorted((tuple(r)[:3] for r in out.collect()), key=str) == plain_stop(rows, streak)
    assert merge.stop_after_streak(df.limit(0), ["g"], "o", F.col("hit"), streak).count() == 0


def test_a_hot_group_is_split(uncoalesced):
    df = uncoalesced.range(20_000).select(F.lit("one").alias("g"), F.col("id").alias("o"), (F.col("id") % 100 == 99).alias("hit"))
    out = merge.stop_after_streak(df, ["g"], "o", F.col("hit"), 2)
    dealt = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(dealt) == 20_000 and len(dealt) >= 3 and max(dealt) < 12_000


def test_selection_by_ranges(uncoalesced):
    keys = random.Random(2).sample(range(10_000), 3000)
    df = uncoalesced.createDataFrame([(k, str(k % 7)) for k in keys], "k int, c string").repartition(4)
    keys.sort()
    for n in (1, 2, 1499, 3000):
        assert sampling.nth_key(df, F.col("k"), n) == (keys[n - 1], None)
    assert sampling.nth_key(df, F.col("k"), 3001) == (None, 3000)
    half = sampling.numbered(df, "k", 1500, 700, F.col("c") != "3")
    assert [r["k"] for r in half.collect()] == [k for k in keys[1500:] if k % 7 != 3][:700]
    plan = half._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "SinglePartition" not in plan
    with_null = df.select("k").unionByName(df.select(F.lit(None).cast("int").alias("k")).limit(1))
    assert [r["k"] for r in sampling.numbered(with_null, "k", 0, 2, F.lit(True)).collect()] == [None, keys[0]]
    assert [r["k"] for r in sampling.numbered(with_null, "k", 1, 2, F.lit(True)).collect()] == keys[:2]
    drawn = [r["k"] for r in sampling.sample(df, "k", 100).collect()]
    top = [r["k"] for r in df.orderBy(sampling.hash_order("k"), "k").limit(100).collect()]
    assert sorted(drawn) == sorted(top) and sampling.sample(df.union(df), "k", 101).count() == 101 and sampling.sample(df, "k", 5000).count() == 3000
