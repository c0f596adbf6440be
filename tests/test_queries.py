import html
import re

import duckdb
import pytest

from marketloom.plans.queries import QUERIES, SQL
from twins import same

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql_twin(spark, name):
    same(spark, QUERIES[name], SQL[name], SMALL)


def table(name):
    return duckdb.sql(f"SELECT * FROM '{SMALL}/{name}.parquet'").fetchdf().to_dict("records")


def test_every_query_without_twin_is_tested_below():
    assert sorted(set(QUERIES) - set(SQL)) == ["q44_html_extract", "q45_snapshot", "q46_hash_sample"]


def squeezed(text):
    return re.sub(r"\s", "", text)


def test_html_extract_against_the_plain_text_of_pages(spark):
    found = {r["page_id"]: r for r in QUERIES["q44_html_extract"](spark, SMALL).collect()}
    pages = table("pages")
    assert len(found) == len(pages)
    for p in pages:
        got, page = found[p["page_id"]], p["html"] or ""
        shown = re.sub(r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->", "", page)
        plain = squeezed(html.unescape(re.sub(r"<[^>]*>", "", shown)))
        blocks = [squeezed(html.unescape(re.sub(r"<[^>]*>", "", b))) for b in re.findall(r"(?is)<p(?:\s[^>]*)?>(.*?)</p>", shown)]
        parts = [squeezed(x) for x in got["generic"].split("\n\n")] if got["generic"] else []
        assert all(x in plain for x in parts) and len(parts) <= 40
        rest = iter(blocks)
        assert all(x in rest for x in parts if x in blocks)  # paragraphs come in the page's order
        assert (got["news"] == "") or 'id="ContentBody"' in page
        assert (got["report"] == "") or "blk_container" in page or "content" in page
        hrefs = {html.unescape(m).strip() for m in re.findall(r"<a\s[^>]*href=[\"']([^\"']*)", page)} - {""}
        assert got["n_links"] <= len({x for x in hrefs if not x.startswith("#")})
    assert sum(r["generic"] != "" for r in found.values()) > len(found) / 2 and sum(r["n_links"] for r in found.values()) > 0


def test_snapshot_against_plain_lists(spark):
    got = QUERIES["q45_snapshot"](spark, SMALL).first()
    customers = {c["c_custkey"]: str(c["c_nationkey"]) for c in table("customer")}
    orders = [o for o in table("orders") if customers[o["o_custkey"]] == "7"]
    newest = sorted(((str(o["o_orderdate"])[:10], str(o["o_orderkey"])) for o in orders), reverse=True)
    assert got["stock"] == "7" and [(str(x["date"]), x["url"]) for x in got["news"]] == newest[:10] and [(str(x["date"]), x["url"]) for x in got["reports"]] == newest[:3]
    events = [e for e in table("events") if e["user_id"] == 7]
    assert [(x["publish_time"], x["url"]) for x in got["comments"]] == sorted(((e["ts"].to_pydatetime(), str(e["event_id"])) for e in events), reverse=True)[:50]
    assert [str(x["trade_date"]) for x in got["kline"]] == sorted({str(e["ts"])[:10] for e in events})[-7:]
    by_query = {}
    for o in sorted(orders, key=lambda o: o["o_orderkey"]):
        by_query.setdefault(o["o_orderpriority"], []).append(o["o_orderkey"])
    assert [(x["query"], x["position"]) for x in got["serp"]] == [(q, k) for q in sorted(by_query) for k in by_query[q][:3]]


def test_hash_sample_is_a_fixed_part_of_each_side(spark):
    runs = [QUERIES["q46_hash_sample"](spark, SMALL).collect() for _ in range(2)]
    assert sorted(runs[0]) == sorted(runs[1])
    known = {d["doc_id"]: d["lang"] for d in table("documents")}
    held = {r[0] for r in spark.createDataFrame([(d,) for d in known], "doc_id long").selectExpr("doc_id", "pmod(xxhash64(doc_id, 42), 1000000) < 100000 AS h").filter("h").collect()}
    ids = {part: [r["doc_id"] for r in runs[0] if r["part"] == part] for part in ("sample", "step")}
    assert len(ids["sample"]) == len(set(ids["sample"])) == 50 and not held & set(ids["sample"])
    assert len(ids["step"]) == min(10, len(held)) and set(ids["step"]) <= held
    assert all(known[r["doc_id"]] == r["lang"] for r in runs[0])


def test_entry_counts(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 292
    assert QUERIES["q06_multi_horizon_labels"](spark, SMALL).count() == 202


def test_predictions_go_through_the_model_one_prompt_a_sample(spark, monkeypatch):
    from marketloom.functions import scalars as S
    from marketloom.sources import fetch

    monkeypatch.setattr(fetch, "offline_client", lambda texts: [S.DOWN if "K线" in t else "?" for t in texts])
    rows = QUERIES["q48_offline_predictions"](spark, SMALL).collect()
    assert len(rows) == QUERIES["q05_kline7_samples"](spark, SMALL).count() and {r["predicted"] for r in rows} == {S.DOWN}


def test_a_page_s_tree_goes_with_its_last_use():
    import gc
    import weakref

    from marketloom.functions import html as pages

    gc.disable()
    try:
        gone = weakref.ref(root := pages.tree("<div><p>a<br>b</p></x><p/>c</div>d"))
        assert root.text("|") == "a|b|c|d"
        del root
        assert gone() is None
    finally:
        gc.enable()
