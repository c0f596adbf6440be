"""Paged sources, the dispatcher of pages and the cache that one driver builds, with services of the tests' own."""

import json
import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from marketloom.sources import cache, pages
from marketloom.streaming import dispatch


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def forum(calls, totals, flaky=()):
    """A service over files: every call is a file in ``calls``; pages in ``flaky`` fail the first two times."""

    class Forum(pages.ForumPages):
        def total(self, symbol):
            return json.load(open(totals)).get(symbol)

        def page(self, symbol, number):
            seen = len([n for n in os.listdir(calls) if n.startswith(f"{symbol}-{number}-")])
            open(f"{calls}/{symbol}-{number}-{seen}", "w").close()
            if (symbol, number) in flaky and seen < 2:
                raise OSError("try again")
            posts = [{"post_id": f"{number}{k}", "stockbar_code": symbol, "post_title": f"t{k}", "art_unique_url": "http://same" if k == 2 else "", "post_publish_time": "2026-01-01 00:00:00"} for k in range(3)]
            return "var x=" + json.dumps({"count": 9, "re": posts if number <= 25 else []}) + ";"

    return Forum("http://forum")


@pytest.fixture
def service(tmp_path):
    (tmp_path / "calls").mkdir()
    (tmp_path / "totals").write_text(json.dumps({"a": 3, "b": 100, "c": None}))
    return lambda **more: forum(str(tmp_path / "calls"), str(tmp_path / "totals"), **more)


def asked(tmp_path):
    return sorted(os.listdir(tmp_path / "calls"))


def test_pages_of_many_symbols(spark, tmp_path, service):
    pages.register(spark, "forum_a", service(flaky={("a", 2)}))
    read = spark.read.format("forum_a").option("symbols", "a, b,c,a").option("maxPages", 40).option("pagesPerTask", 8).option("retrySeconds", 0).load()
    found = read.collect()
    assert {(r["symbol"], r["page"]) for r in found} == {("a", n) for n in (1, 2, 3)} | {(s, n) for s in "bc" for n in range(1, 26)} and len(found) == 3 * 53
    assert len([n for n in asked(tmp_path) if n.startswith("a-2-")]) == 3 and not any(n.startswith(("a-4", "b-41", "c-41")) for n in asked(tmp_path))
    assert read.rdd.getNumPartitions() == 1 + 5 + 5
    listed = pages.listed(read)
    assert listed.groupBy("symbol", "url").count().filter("count > 1").count() == 0 and listed.filter("url = 'http://same'").count() == 3
    assert rows(pages.newest(read, 4).select("symbol", "page", "pos")) == [(s, p, q) for s in "abc" for p, q in ((1, 0), (1, 1), (1, 2), (2, 0))]
    assert spark.read.format("forum_a").load().count() == 0


def test_failures_beyond_the_retries_are_errors(spark, service):
    pages.register(spark, "forum_b", service(flaky={("a", 2)}))
    with pytest.raises(Exception, match="try again"):
        spark.read.format("forum_b").option("symbols", "a").option("attempts", 2).option("retrySeconds", 0).load().collect()


def test_pages_without_anything_new_end_a_symbol(spark):
    read = spark.createDataFrame([("s", p, k, f"u{p if p < 3 or p > 6 else 1}{k}", "t", "", "") for p in range(1, 9) for k in range(2)] + [("t", 1, 0, " ", "", "", "")], pages.ROWS)
    assert {r["page"] for r in pages.listed(read, streak=3).collect()} == {1, 2} and {r["page"] for r in pages.listed(read, streak=5).collect()} == {1, 2, 7, 8}
    known = read.select("symbol", "url").filter("url in ('u10', 'u11')")
    assert {r["page"] for r in pages.listed(read, streak=9, known=known).collect()} == {2, 7, 8}


def test_html_lists_are_services(spark):
    class News(pages.HtmlPages):
        def total(self, symbol):
            return None

        def page(self, symbol, number):
            return f'<div class="news_item"><div class="news_item_t"><a href="/{symbol}{number}">x</a></div><div class="news_item_c">s</div></div>' if number < 3 else ""

    service = News("news", "http://n")
    assert [r for n in (1, 2, 3) for r in service.rows(service.page("s", n))] == [("http://n/s1", "x", "s", ""), ("http://n/s2", "x", "s", "")]


def test_a_stream_goes_on_where_it_stood(spark, tmp_path, service):
    pages.register(spark, "forum_c", service())
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def run():
        query = spark.readStream.format("forum_c").option("symbols", "a,b").option("maxPages", 20).load().writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        return {(r["symbol"], r["page"]) for r in spark.read.parquet(out).collect()}

    assert run() == {("a", n) for n in (1, 2, 3)} | {("b", n) for n in range(1, 21)}
    (tmp_path / "totals").write_text(json.dumps({"a": 5, "b": 100}))
    before = set(asked(tmp_path))
    assert run() == {("a", n) for n in range(1, 6)} | {("b", n) for n in range(1, 21)}
    assert {n.rsplit("-", 1)[0] for n in set(asked(tmp_path)) - before} == {"a-4", "a-5"}


def test_pages_are_dealt_once_in_a_run(spark, tmp_path):
    landing, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))

    def tell(*events):
        spark.createDataFrame(list(events), dispatch.EVENTS).coalesce(1).write.mode("append").json(landing)
        stream = dispatch.dispatched(spark.readStream.schema(dispatch.EVENTS).json(landing), cap=100, streak=2)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        at = min(e[4] for e in events)
        return rows(spark.read.schema(dispatch.DEALT).parquet(out).filter(F.col("at") >= at).select("company", "page", "reason").fillna("-").fillna(-1))

    ask = lambda company, at: (company, "ask", None, None, at)
    assert tell(("x", "start", 4, None, 1), ask("x", 2), ask("x", 3), ("y", "start", None, None, 1), ask("y", 2)) == [("x", 1, "-"), ("x", 2, "-"), ("y", 1, "-")]
    # Each call is a new query over the same checkpoint: the state survives.  The failed page isn't dealt again.
    assert tell(("x", "failed", 1, None, 10), ("x", "done", 2, 30, 11), ask("x", 12), ask("x", 13), ask("x", 14)) == [("x", -1, "no page left"), ("x", 3, "-"), ("x", 4, "-")]
    assert tell(("x", "start", 6, None, 20), ask("x", 21), ask("x", 22)) == [("x", 1, "-"), ("x", 3, "-")]
    assert tell(("x", "done", 1, 80, 30), ask("x", 31), ("y", "done", 1, 0, 30), ("y", "done", 2, None, 31), ("y", "done", 3, 0, 32), ask("y", 33)) == [("x", -1, "cap"), ("y", 4, "-")]
    assert tell(("y", "done", 4, 0, 40), ask("y", 41), ("z", "stop", None, None, 40), ask("z", 41)) == [("y", -1, "nothing new"), ("z", -1, "stopped")]


def test_of_several_drivers_one_builds(spark, tmp_path):
    built = []

    def make():
        built.append(1)
        time.sleep(1.5)
        return spark.range(7)

    got = []
    drivers = [threading.Thread(target=lambda: got.append(cache.cached(spark, make, str(tmp_path), {"a": 1}, beat=0.2, stale=5).count())) for _ in range(3)]
    for d in drivers:
        d.start()
    for d in drivers:
        d.join()
    assert got == [7, 7, 7] and built == [1] and cache.cached(spark, make, str(tmp_path), {"a": 1}).count() == 7 and built == [1]
    assert cache.cached(spark, lambda: spark.range(2), str(tmp_path), {"a": 2}).count() == 2


def test_failed_and_dead_builders(spark, tmp_path):
    def broken():
        time.sleep(1)
        raise ValueError("no tokens")

    seen = []

    def waits():
        try:
            cache.cached(spark, lambda: spark.range(1), str(tmp_path), {"b": 1}, beat=0.1, stale=5)
        except cache.BuildFailed as error:
            seen.append(str(error))

    other = threading.Thread(target=lambda: (time.sleep(0.4), waits()))
    other.start()
    with pytest.raises(ValueError):
        cache.cached(spark, broken, str(tmp_path), {"b": 1}, beat=0.1)
    other.join()
    assert seen == ["ValueError: no tokens"]
    assert cache.cached(spark, lambda: spark.range(4), str(tmp_path), {"b": 1}).count() == 4  # a later call tries again
    files = cache.Files(spark, f"{tmp_path}/{cache.digest({'b': 2})}")
    files.publish("lease-000001", json.dumps({"at": time.time() - 3600}))  # its holder died an hour ago
    assert cache.cached(spark, lambda: spark.range(5), str(tmp_path), {"b": 2}).count() == 5
    files = cache.Files(spark, f"{tmp_path}/{cache.digest({'b': 3})}")
    files.publish("lease-000001", json.dumps({"at": time.time()}))
    with pytest.raises(TimeoutError):
        cache.cached(spark, lambda: spark.range(5), str(tmp_path), {"b": 3}, patience=1)
