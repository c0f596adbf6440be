"""Kept-up-to-date retention, mergeable scalers and what comments agree on, against plain versions."""

import json
import math
import random
from collections import Counter
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from marketloom.operators import bars as B
from marketloom.operators import consensus, merge
from marketloom.sources.versions import Files, Table
from marketloom.streaming import retention

COMMENTS = "url string, post_id string, symbol string, publish_time string, click_count string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def comments(rng, n, first):
    days = ["2026-01-05 10:00:00", "2026-01-05 23:59:59", "2026-01-06 00:00:00", "bad", "2026-02-01 08:00:00"]
    out = []
    for i in range(n):
        k = first + i if rng.random() < 0.8 else rng.randrange(max(first, 1))  # some were there before
        out.append((f"u{k:04}", f"p{k % 7}", "hot" if k % 5 else "s", days[k % 5], rng.choice(["0", "3.9", "x", str(k % 11)])))
    return out


def test_retention_by_batches_is_one_trim_of_all(spark, tmp_path):
    rng = random.Random(3)
    kept, floors = retention.tables(spark, str(tmp_path / "c"))
    everything = None
    for batch in range(6):
        part = spark.createDataFrame(comments(rng, 60, 60 * batch), COMMENTS)
        everything = spark.createDataFrame(merge.merge_comments(part.limit(0) if everything is None else everything, part, 8).collect(), COMMENTS)
        retention.retain_batch(kept, floors, part, batch, "s", 8)
        assert rows(kept.read().select("url", "post_id", "symbol", "publish_time", "click_count")) == rows(everything)
        assert rows(floors.read()) == rows(retention.floors_of(kept.read(), 8))
    now = kept.current()
    assert retention.retain_batch(kept, floors, part, 5, "s", 8) == [] and kept.current() == now  # a batch again


def test_a_batch_reads_only_days_that_it_can_change(spark, tmp_path):
    kept, floors = retention.tables(spark, str(tmp_path / "c"))
    first = [(f"u{i:02}", "p", "s", f"2026-01-{1 + i % 3:02} 10:00:00", str(10 + i)) for i in range(30)]
    retention.retain_batch(kept, floors, spark.createDataFrame(first, COMMENTS), 0, "s", 5)
    before = kept.current()
    low = [("a", "p", "s", "2026-01-01 10:00:00", "1"), ("b", "p", "s", "2026-01-02 11:00:00", "99")]
    assert retention.retain_batch(kept, floors, spark.createDataFrame(low, COMMENTS), 1, "s", 5) == ["v2026-01-02"]
    after = kept.current()
    assert [p for p in before.parts if after.parts[p] != before.parts[p]] == ["v2026-01-02"]
    assert retention.retain_batch(kept, floors, spark.createDataFrame(low[:1], COMMENTS), 2, "s", 5) == [] and kept.current() == after


def test_floors_are_taken_anew_after_a_driver_died_between_the_tables(spark, tmp_path, monkeypatch):
    kept, floors = retention.tables(spark, str(tmp_path / "c"))
    part = lambda clicks, first: spark.createDataFrame([(f"u{first + i}", "p", "s", "2026-01-01 10:00:00", str(clicks)) for i in range(5)], COMMENTS)
    retention.retain_batch(kept, floors, part(1, 0), 0, "s", 5)
    publish = Files.publish
    with monkeypatch.context() as m:
        m.setattr(Files, "publish", lambda self, name, text: publish(self, name, text) if self.root.endswith("comments") else (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(OSError):
            retention.retain_batch(kept, floors, part(5, 10), 1, "s", 5)
    assert kept.current().number == 2 and floors.current().number == 1
    assert retention.retain_batch(kept, floors, part(5, 10), 1, "s", 5) == []  # the comments are in
    assert retention.retain_batch(kept, floors, part(3, 20), 2, "s", 5) == [] and {r["click_count"] for r in kept.read().collect()} == {"5"}


def test_retention_of_a_stream(spark, tmp_path):
    landing, path, checkpoint = (str(tmp_path / x) for x in ("in", "t", "checkpoint"))
    for n in range(2):
        spark.createDataFrame([(f"u{n}{i}", "p", "s", "2026-01-01 10:00:00", str(i + n)) for i in range(9)], COMMENTS).write.mode("append").parquet(landing)
        retention.retain_stream(spark, landing, COMMENTS, path, checkpoint, n=4).awaitTermination()
    assert [r["url"] for r in Table(spark, f"{path}/comments", split="day").read().orderBy("url").collect()] == ["u07", "u08", "u17", "u18"]


def test_expanding_scalers_equal_refits(spark):
    rng = random.Random(4)
    first, out = date(2025, 11, 25), []
    for symbol, n in (("a", 70), ("b", 3), ("c", 1), ("flat", 40)):
        for k in range(n):
            pct = None if rng.random() < 0.1 else 1e6 + rng.gauss(0, 0.01)
            price = 5.0 if symbol == "flat" else rng.uniform(1, 9)
            out.append((symbol, first + timedelta(k if k < 30 else k + 45), price, price, price, price, None if symbol == "b" else rng.uniform(0, 3), rng.choice([None, 0.0, -1.0, 1e12]), pct))
    df = spark.createDataFrame(out, "symbol string, trade_date date, open double, high double, low double, close double, turnover double, volume double, pct_change double").repartition(5)
    got = {(r["symbol"], r["trade_date"]): r.asDict() for r in B.expanding_scalers(df).collect()}
    assert len(got) == len(out) - 4
    for day in (first + timedelta(1), first + timedelta(29), first + timedelta(80), first + timedelta(114)):
        for r in B.fit_scaler(df, F.col("trade_date") < F.lit(day)).collect():
            if (r["symbol"], day) in got:
                own = got[r["symbol"], day]
                assert all(own[c] == v if isinstance(v, (int, str)) else math.isclose(own[c], v, rel_tol=1e-6, abs_tol=1e-12) for c, v in r.asDict().items())
    assert B.expanding_scalers(df.limit(0)).count() == 0


TITLES = ["利好 Bank profits", "bank 跌停", "银行利好", "the bank", "x", None, "", "oil 卖出 oil", "Oil 涨", "银行 oil"]


def test_clusters_of_comments(spark):
    posts = [(s, f"{s}{i}", t, i % 4) for s, titles in (("a", TITLES), ("b", TITLES[:1]), ("c", [None])) for i, t in enumerate(titles)]
    df = spark.createDataFrame(posts, "symbol string, url string, post_title string, clicks int")

    def tokens(t):
        import re

        found = []
        for w in dict.fromkeys(x for x in re.split(r"[\W_]+", (t or "").lower()) if len(x) > 1):
            found += [w[i : i + 2] for i in range(len(w) - 1)] if re.search("[一-鿿]", w) else [w]
        return set(found)

    held = {(s, u): tokens(t) for s, u, t, _ in posts}
    counts = {s: Counter(w for (x, _), ws in held.items() if x == s for w in ws) for s in "abc"}
    total = Counter(s for s, *_ in posts)

    def topic(s, u):
        fine = [(-counts[s][w], w) for w in held[s, u] if 2 <= counts[s][w] < total[s]]
        return min(fine)[1] if fine else ""

    got = {(r["symbol"], r["url"]): (r["topic"], r["mood"]) for r in consensus.clustered(df).collect()}
    assert {k: v[0] for k, v in got.items()} == {(s, u): topic(s, u) for s, u, *_ in posts}
    assert got["a", "a0"][1] == "positive" and got["a", "a1"][1] == "negative" and got["a", "a5"][1] == "neutral"
    told = {r["symbol"]: r for r in consensus.consensus(df, F.col("clicks"), topics=2).collect()}
    assert told["a"]["n"] == 10 and json.loads(told["a"]["distribution"]) == {"positive": 0.3, "neutral": 0.5, "negative": 0.2}
    clusters = json.loads(told["a"]["clusters"])
    sizes = Counter(topic("a", f"a{i}") for i in range(10))
    assert [(c["topic"], c["n"]) for c in clusters] == sorted(sizes.items(), key=lambda x: (-x[1], x[0]))[:2]
    for c in clusters:
        own = [(-(i % 4), f"a{i}") for i in range(10) if topic("a", f"a{i}") == c["topic"]]
        assert c["example"] == min(own)[1] and abs(sum(c["mood"].values()) - 1) < 1e-5
    plan = consensus.consensus(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
