"""Content, marks, list pages and merges by partition."""

import os
from datetime import date

import pytest
from pyspark.sql import functions as F

from marketloom.functions import answers as A
from marketloom.functions import html
from marketloom.functions import scalars as S
from marketloom.operators import content, sampling
from marketloom.sources import text_files, writers
from marketloom.sources.versions import Table
from marketloom.streaming import incremental, marks


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_summary_file_without_separator_is_an_error(spark):
    files = spark.createDataFrame([("a.txt", "URL=x\nno body")], "path string, value string")
    with pytest.raises(Exception, match="no separator"):
        content.summary_items(files, spark.createDataFrame([("s",)], "symbol string")).collect()


def test_reports_are_kept_once_a_url_and_news_once_a_day(spark):
    d = date(2026, 1, 31), date(2026, 2, 1)
    listed = spark.createDataFrame([("b", "u", "t", d[0]), ("a", "u", "t", d[0]), ("a", "u", "t", d[1]), ("", "u", "t", d[1]), ("a", "v", "t", None), ("a", "w", "t", d[0])], "symbol string, url string, title string, item_date date")
    key = lambda u: __import__("hashlib").sha256(u.encode()).hexdigest()
    cache = spark.createDataFrame([(key("u"), "2026-01", " x \n"), (key("u"), "2026-02", "y"), (key("w"), "2026-01", " ")], "url_hash string, ym string, body string")
    assert rows(content.with_bodies(listed, cache)) == [("a", d[0], "u", "t", "x"), ("a", d[1], "u", "t", "y")]
    assert rows(content.with_bodies(listed, cache.filter("ym = '2026-02'").drop("ym"), by_month=False)) == [("a", d[0], "u", "t", "y")]


def test_two_stage_news_and_feedback(spark):
    chosen = spark.createDataFrame([("s", ["u2", "gone", "u1"])], "symbol string, ids array<string>")
    listed = spark.createDataFrame([("s", f"u{i}", f"t{i}", date(2026, 1, i)) for i in (1, 2, 3)], "symbol string, url string, title string, item_date date")
    cache = listed.select(S.url_key(F.col("url")).alias("url_hash"), F.lit("2026-01").alias("ym"), F.concat(F.lit("body "), "url").alias("body"))
    assert rows(content.chosen_bodies(chosen, listed, cache).select("place", "url", "content")) == [(0, "u2", "body u2"), (2, "u1", "body u1")]
    assert rows(content.chosen_bodies(chosen, listed, cache, most=1).select("url")) == [("u2",)]
    said = spark.createDataFrame([("s", "d1", "{}", "涨"), ("s", "d2", "{}", "跌")], "symbol string, day string, snapshot string, output string")
    assert rows(content.feedback(said, spark.createDataFrame([("s", "d1", "涨")], "symbol string, day string, label string")).select("day", "label")) == [("d1", "涨"), ("d2", None)]


def test_pdf_note_tally_and_pending(spark):
    found = spark.createDataFrame([("http://a/x.PDF ",), ("http://a/pdf",), (None,)], "url string")
    note = content.pdf_note(found).first()
    assert (note["kept"], note["removed"]) == (2, 1) and note["note"] == "已过滤掉 1 条 PDF 链接，保留 2 / 3 条普通网页结果。"
    assert content.without_pdfs(found).count() == 2
    assert rows(content.tally(spark.createDataFrame([("ok",), ("ok",), ("fail",)], "status string"))) == [("fail", 1), ("ok", 2)]
    pending = spark.createDataFrame([("u", None), ("v", " 　"), ("w", "x"), (" ", None), (None, None)], "url string, content string")
    assert rows(content.unfetched(pending).select("url")) == [("u",), ("v",)]
    assert rows(content.fetched_updates(spark.createDataFrame([("u", None), ("v", ""), ("w", "x")], "url string, content string"))) == [("v", ""), ("w", "x")]
    assert rows(content.dated(spark.createDataFrame([("u", None), ("v", " "), ("w", "2026-01-01")], "url string, date string")).select("url")) == [("w",)]
    companies = spark.createDataFrame([(i, f"s{i}") for i in range(80)], "pos int, symbol string")
    assert [r["pos"] for r in content.from_offset(companies, 79, "pos").orderBy("pos").collect()] == [78, 79]
    assert content.dry_run(companies, "pos").count() == 50


def test_completions_by_number(spark):
    asked = sampling.ordinal(spark.createDataFrame([(k, f"p{k}") for k in range(100, 60, -1)], "k int, prompt string").repartition(5), "k")
    assert [(r["i"], r["k"]) for r in asked.orderBy("i").collect()] == [(i, 61 + i) for i in range(40)]
    done = spark.createDataFrame([("7", "a"), ("9", "b"), ("x", "c")], "custom_id string, completion string")
    got = {r["i"]: r for r in content.reasoning_set(asked, done, 7).collect()}
    assert got[0]["completion"] == "a" and got[1]["completion"] == "" and got[2]["completion"] == "b" and got[0]["prompt"].startswith("p61\n\n") and len(got) == 40
    assert sampling.ordinal(asked.select("k", "prompt").limit(0), "k").count() == 0


def test_offset_counts_all_rows_and_limit_valid_ones(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(30)], "k int, odd int")
    take = lambda offset, limit: [r["k"] for r in sampling.numbered(df, "k", offset, limit, F.col("odd") == 1).orderBy("k").collect()]
    assert take(5, 3) == [5, 7, 9] and take(0, None) == list(range(1, 30, 2)) and take(30, 5) == [] and take(29, 5) == [29] and take(99, 1) == []
    plan = sampling.numbered(df, "k", 5, 3, F.col("odd") == 1)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "TakeOrdered" not in plan


def test_shapes_of_completions_and_references(spark):
    df = spark.createDataFrame([("a", [("x",)], []), ("b", [], [])], "s string, m array<struct<content: string>>, n array<struct<content: string>>")
    got = df.select(A.completion_text(F.col("s"), df.schema["s"].dataType), A.completion_text(F.col("m"), df.schema["m"].dataType)).collect()
    assert [tuple(r) for r in got] == [("a", "x"), ("b", "")]
    pairs = spark.createDataFrame([("涨，跌，涨", "涨\n涨\n涨"), (" ", "涨\n跌\n跌"), (None, "?"), ("涨，跌", "涨\n跌\n跌")], "l string, c string")
    assert [r[0] for r in pairs.select(A.reference_triplet(F.col("l"), F.col("c"))).collect()] == [["涨", "跌", "涨"], ["涨", "跌", "跌"], None, None]


def test_symbols_and_endpoints(spark):
    df = spark.createDataFrame([("600000", "a"), ("000001", "a")], "s string, m string")
    assert [tuple(r) for r in df.select(S.vendor_symbol(F.col("s"), F.col("m")), S.endpoint(F.col("m"))).collect()] == [("sh600000", "stock_zh_a_hist"), ("sz000001", "stock_zh_a_hist")]
    hong_kong = spark.createDataFrame([(" hk00700 ", "hk")], "s string, m string")
    assert tuple(hong_kong.select(S.upper_symbol(F.col("s")), S.endpoint(F.col("m"))).first()) == ("HK00700", "stock_hk_hist")
    with pytest.raises(Exception, match="no vendor form"):
        hong_kong.select(S.vendor_symbol(F.col("s"), F.col("m"))).collect()


NEWS = '<div class="news_list"><div class="news_item"><div class="news_item_t"><a href="//x/a/20260105123.html"> Big <b>news</b></a></div><div class="news_item_c">snippet</div></div><div class="news_item"><div class="news_item_t"><a href="#">no</a></div></div><div class="news_item"></div></div>'
REPORTS = '<table class="tb_01"><tr><th>h</th></tr><tr><td>1</td><td class="tal f14"><a href="/r/1" title="Full title">Short</a></td><td>k</td><td> 2026-01-02 </td></tr><tr><td class="tal"><a href="/r/2">Two</a></td></tr></table><table><tr><td class="tal"><a href="/no">No</a></td></tr></table>'
FORUM = '<a class="nump" href="list,600000,f_12.html"><span>12</span></a><a href="x,f_9.html">9</a><a class="nump" href="#"><span>30</span></a><a href="y">40</a>'


def test_list_pages(spark):
    df = spark.createDataFrame([(NEWS, REPORTS, FORUM, 801), ("", None, "<p>", 801), (None, "", None, None)], "n string, r string, f string, count long")
    got = df.select(html.list_rows("news")("n").alias("n"), html.list_rows("report")("r").alias("r"), html.linked_pages()("f").alias("p"), "count").withColumn("pages", S.page_count(F.col("p"), F.col("count"))).collect()
    assert [tuple(x) for x in got[0]["n"]] == [("//x/a/20260105123.html", "Big news", "snippet", "")]
    assert [tuple(x) for x in got[0]["r"]] == [("/r/1", "Full title", "", "2026-01-02"), ("/r/2", "Two", "", "")]
    assert [r["pages"] for r in got] == [30, 11, 1] and got[1]["n"] == got[1]["r"] == got[2]["n"] == []


def test_marks_in_one_form(spark):
    states = {"int": "3", "list": "[4,2,2]", "whole": '{"total_pages": 3, "completed": [3, 1, 2]}', "part": '{"total_pages": 5, "completed": 2}', "capped": '{"total_pages": 9, "completed": [1], "capped_at": 10000}', "bad": "x", "none": None}
    df = spark.createDataFrame(list(states.items()), "company string, state string")
    assert dict(rows(marks.compacted(df))) == {"int": "3", "list": '{"total_pages":1,"completed":[2,4]}', "whole": "3", "part": '{"total_pages":5,"completed":[1,2]}', "capped": states["capped"], "bad": '{"total_pages":1,"completed":[]}', "none": '{"total_pages":1,"completed":[]}'}
    more = spark.createDataFrame([("part", 3), ("part", 5), ("part", 4), ("new", 1), ("new", 2)], "company string, page int")
    got = dict(rows(marks.with_pages(df, more)))
    assert got["part"] == "5" and got["new"] == "1" and got["int"] == "3" and got["list"] == '{"total_pages":1,"completed":[2,4]}'


def test_pages_stop_at_the_cap(spark, tmp_path):
    df = spark.createDataFrame([("a", 4, "[2]"), ("b", 3, None), ("c", 2, "2")], "company string, total long, state string")
    saved = spark.createDataFrame([("a", 9_999), ("b", 10_000)], "company string, n_rows long")
    assert rows(marks.pages_to_fetch(df, saved)) == [("a", 1), ("a", 3), ("a", 4)]
    assert len(rows(marks.pages_to_fetch(df, saved, use_marks=False))) == 6
    full = marks.capped_marks(df.withColumn("state", F.when(F.col("company") == "b", '{"total_pages": 3, "completed": [1]}').otherwise(F.col("state"))), saved)
    path = str(tmp_path / "marks")
    marks.write_marks(full, path)
    read = marks.read_marks(spark, path)
    assert [r["p"] for r in read.filter("company = 'b'").select(incremental.pages_done("state").alias("p")).collect()] == [[1, 2, 3]]
    assert marks.read_marks(spark, path, use_marks=False).count() == marks.read_marks(spark, str(tmp_path / "none")).count() == 0
    done = spark.createDataFrame([("news", "z"), ("news", "a"), ("other", "q"), ("news", "a")], "platform string, item string")
    assert marks.completed(done, "news").first()["items"] == ["a", "z"] and marks.completed(done, "x").first()["items"] == []


def test_a_stream_rewrites_only_the_partitions_it_touches(spark, tmp_path):
    landing, target, checkpoint = (str(tmp_path / x) for x in ("landing", "target", "checkpoint"))
    schema = "symbol string, trade_date string, close double, o int"

    def land(*new, after=None):
        spark.createDataFrame(list(new), schema).write.mode("append").parquet(landing)
        incremental.merge_stream(spark, landing, schema, target, ["symbol", "trade_date"], checkpoint, mode="upsert", order="o", partition="trade_date", files_a_batch=1, after=after).awaitTermination()
        return Table(spark, target, split="trade_date")

    untouched = land(("a", "d1", 1.0, 1), ("b", "d1", 2.0, 1), ("a", "d2", 3.0, 1)).current().parts
    table = land(("a", "d2", 4.0, 2), ("c", "d2", 5.0, 1), ("a", "d3", 6.0, 1))
    assert table.current().parts["vd1"] == untouched["vd1"] and table.current().parts["vd2"] != untouched["vd2"]
    assert rows(table.read().select("symbol", "trade_date", "close")) == [("a", "d1", 1.0), ("a", "d2", 4.0), ("a", "d3", 6.0), ("b", "d1", 2.0), ("c", "d2", 5.0)]
    # A part whose rows all go is empty afterwards.
    table = land(("a", "d3", 7.0, 3), after=lambda df: df.filter("close < 7"))
    assert rows(table.read().select("symbol", "trade_date")) == [("a", "d1"), ("a", "d2"), ("b", "d1"), ("c", "d2")]


def test_four_places_by_the_exact_value(spark):
    values = [0.78125, 0.03125, -0.03125, 0.00005, -0.00001, 0.0, 1.00005, 0.12345, 123456.78905, 99999999.99995, 1e12 + 0.12345] + [k / 2**j for k in (1, 3, 12345, 999999) for j in range(1, 20)]
    df = spark.createDataFrame([(x,) for x in values], "x double")
    for r in df.select("x", S.fmt4(F.col("x")).alias("a"), S.fmt_signed4(F.col("x")).alias("b"), S.round4(F.col("x")).alias("c")).collect():
        assert (r["a"], r["b"]) == (f"{r['x']:.4f}", f"{r['x']:+.4f}") and (abs(r["x"]) > 1e11 or r["c"] == round(r["x"], 4))


def test_section_summaries_and_predictions(spark):
    from marketloom.plans import live

    kind = "symbol string, name string, items array<struct<date: string, title: string, content: string>>"
    df = spark.createDataFrame([("s", "n", [("d", "t", "c")])], kind)
    echo = lambda texts: [f" {t} " for t in texts]
    assert live.section_summaries(df, " News ", echo, "look").first()["summary"] == "股票：n（s）\nlook\n1. 日期=d\n标题=t\n正文=c"
    with pytest.raises(ValueError):
        live.section_summaries(df, "weather", echo)
    with pytest.raises(Exception, match="nothing to summarise"):
        live.section_summaries(spark.createDataFrame([("s", "n", [])], kind), "news", echo).collect()
    with pytest.raises(Exception, match="no answer"):
        live.section_summaries(df, "news", lambda texts: [" "] * len(texts)).collect()
    bars = "kline array<struct<trade_date: string, open: double, close: double, high: double, low: double, change_amount: double, pct_change: double, volume: double, amount: double>>"
    rows_ = spark.createDataFrame([("s", "n", [("d", 1.0, 2.0, 3.0, 0.5, 1.0, 2.0, 9.0, 8.0)], " up ", None, "")], f"symbol string, name string, {bars}, news_summary string, reports_summary string, serp_summary string")
    told = live.trend_predictions(rows_, echo).first()["prediction"]
    assert "新闻 Summary：\nup" in told and told.count("未提供") == 2 and "1. 日期=d 开=1.0" in told
    with pytest.raises(Exception, match="no bars"):
        live.trend_predictions(rows_.withColumn("kline", F.filter("kline", lambda x: F.lit(False))), echo).collect()


def test_newest_comments_are_limited_in_page_order(spark):
    from marketloom.plans import live

    posts = [("s", 1, 0, "a", "2026-01-01"), ("s", 1, 1, "b", "2026-01-03"), ("s", 1, 2, "a", "2026-01-09"), ("s", 2, 0, "c", "2026-01-02"), ("s", 2, 1, "d", "2026-01-08"), ("s", 4, 0, "e", "2026-02-01"), ("s", 1, 3, " ", "2026-01-01")]
    got = live.newest_comments(spark.createDataFrame(posts, "symbol string, page int, pos int, url string, publish_time string"), limit=3)
    assert [(r["rank"], r["url"]) for r in got.orderBy("rank").collect()] == [(1, "b"), (2, "c"), (3, "a")]


def test_search_results_with_the_text_of_their_pages(spark):
    from marketloom.plans import live

    pages = {"u1": "<article><p>a long enough paragraph</p></article>", "u2": ""}
    found = spark.createDataFrame([("u1", 1), ("u2", 2), ("u1", 3)], "url string, position int")
    got = live.with_contents(found, lambda r: [{"url": r["url"], "html": pages[r["url"]]}])
    assert rows(got.select("position", "content")) == [(1, "a long enough paragraph"), (2, ""), (3, "a long enough paragraph")]


def test_dataset_files_and_exports(spark, tmp_path):
    df = spark.createDataFrame([(2, 'b "x"\ny'), (1, "a")], "i int, t string")
    writers.write_dataset(df.coalesce(1), str(tmp_path / "set"), "i")
    text = "".join(open(f"{tmp_path}/set/{f}", newline="").read() for f in sorted(os.listdir(tmp_path / "set")) if f.startswith("part"))
    assert [x for x in text.split("\r\n") if x and x != "i,t"] == ["1,a", '2,"b ""x""\ny"']
    files = spark.createDataFrame([("news/2026-01/x.txt", "héllo\n"), ("report/y.txt", "")], "path string, value string")
    for _ in range(2):
        writers.export_files(files, str(tmp_path / "out"))
    assert rows(text_files.read(spark, str(tmp_path / "out"))) == [("news/2026-01/x.txt", "héllo\n"), ("report/y.txt", "")]
    with pytest.raises(Exception, match="leaves"):
        writers.export_files(spark.createDataFrame([("../z.txt", "")], "path string, value string"), str(tmp_path / "out"))


def test_chat_template_before_the_cut(spark):
    from marketloom.operators import tokens

    df = spark.createDataFrame([(1, " abc "), (2, "a" * 20), (3, None)], "i int, prompt string")
    out = tokens.templated(df, lambda t: f"<{t}>", lambda t: [ord(c) for c in t], lambda ids: "".join(map(chr, ids)), 10)
    assert rows(out) == [(1, "<abc>"), (2, "a" * 9 + ">"), (3, "<>")]


def test_resume_and_shares(spark):
    from marketloom.operators import scoring

    paths = spark.createDataFrame([("o/checkpoint-5",), ("o/checkpoint-40/",), ("o/other",)], "path string")
    assert scoring.resume_from(" None ", paths) is None and scoring.resume_from("auto", paths) == "o/checkpoint-40/" and scoring.resume_from("checkpoint-5", paths) == "o/checkpoint-5"
    assert scoring.resume_from("auto", paths.limit(0)) is None
    with pytest.raises(ValueError):
        scoring.resume_from("checkpoint-6", paths)
    assert scoring.trainable_share(spark.createDataFrame([(1, True), (3, False)], "n long, trainable boolean")).first()["percent"] == 25.0
    assert [r["k"] for r in sampling.first_rows(spark.createDataFrame([(3,), (1,), (2,)], "k int"), "k", 2).collect()] == [1, 2]
