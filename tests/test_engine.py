import os
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from marketloom.functions import answers as A
from marketloom.functions import html, prompts
from marketloom.functions import scalars as S
from marketloom.operators import asof, bars, merge, sampling, scoring, tokens
from marketloom.schemas import require_columns, resolve_quotes
from marketloom.session import load_env
from marketloom.sources import fetch, jobs, readers, writers
from marketloom.sources.versions import Table
from marketloom.streaming import incremental


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("text,expected", [("理由\n涨，跌，涨", "涨，跌，涨"), ("涨, 跌 , 涨", "涨，跌，涨"), ("涨\n跌\n涨", "提取失败"), ("最终答案：跌，跌，涨。", "跌，跌，涨"), ("", "提取失败"), (None, "提取失败"), ("　涨　跌　涨　", "涨，跌，涨")])
def test_one_line_triplet(spark, text, expected):
    assert one(spark, A.one_line_triplet, text) == expected


@pytest.mark.parametrize("text,whole,partial", [
    ("未来1个交易日：上涨\n未来3个交易日: 跌\n未来7个交易日：涨", ["涨", "跌", "涨"], ["涨", "跌", "涨"]),
    ("未来1个交易日：涨\n未来7个交易日：跌", None, ["涨", None, "跌"]),
    ("涨\n跌\n涨", ["涨", "跌", "涨"], [None] * 3),
    ("理由\n涨，跌，涨", None, [None] * 3),
    (None, None, [None] * 3),
])
def test_three_line_parsers(spark, text, whole, partial):
    assert one(spark, A.final_triplet, text) == whole
    assert one(spark, A.partial_triplet, text) == partial


@pytest.mark.parametrize("text,expected", [("分析\n涨", "涨"), ("跌\n说明", "跌"), ("最终答案：涨。", "涨"), ("因此判断为跌势", "跌"), ("不确定", "提取失败"), (None, "提取失败")])
def test_single_label(spark, text, expected):
    assert one(spark, A.single_label, text) == expected


@pytest.mark.parametrize("raw,expected", [("2026-01-05T00:00:00", date(2026, 1, 5)), ("20260105", date(2026, 1, 5)), ("2026-1-5", None), ("2026-02-30", None), ("", None), (None, None)])
def test_lenient_dates(spark, raw, expected):
    assert one(spark, S.parse_date10, raw) == expected


@pytest.mark.parametrize("raw,expected", [("3.2500", "3.25"), ("0", "0"), ("100", "100"), ("1E2", "100"), (None, "N/A"), ("0.00", "0")])
def test_amplitude(spark, raw, expected):
    assert one(spark, S.fmt_amplitude, raw) == expected


def test_numbers(spark):
    assert one(spark, S.number, "nan") is None and one(spark, S.number, "") is None and one(spark, S.number, " 1.5 ") == 1.5
    assert one(spark, S.truncated_int, "12.9") == 12 and one(spark, S.truncated_int, "1e3") == 1000 and one(spark, S.truncated_int, "abc") == 0
    assert one(spark, lambda x: S.fmt_number(x.cast("double")), "12.500000") == "12.5" and one(spark, lambda x: S.fmt_number(x.cast("double")), "3.0") == "3"
    assert one(spark, S.strip_u, "　 a\tb \n") == "a\tb"
    assert one(spark, lambda x: S.ellipsis(x, 3), "abcd") == "abc……" and one(spark, lambda x: S.ellipsis(x, 3), None) == ""
    assert one(spark, lambda x: S.direction(x.cast("double")), "0") == "涨" and one(spark, lambda x: S.direction(x.cast("double")), "NaN") is None


def series(spark, n, symbol="000001", close=lambda i: 10.0 + i % 3):
    rows = [(symbol, date(2026, 1, 1) + timedelta(i), close(i), close(i), close(i), close(i), 100.0 * (i + 1), "3.2500", None if i == 0 else float(i % 2) - 0.5, 1.0) for i in range(n)]
    return spark.createDataFrame(rows, "symbol string, trade_date date, open double, close double, high double, low double, volume double, amplitude string, pct_change double, turnover double")


@pytest.mark.parametrize("n", [1, 7, 8, 11, 12, 13, 14, 15, 30])
def test_sample_counts(spark, n):
    from marketloom.plans import datasets as D

    b = series(spark, n)
    every = D.half_open("1900-01-01", "2100-01-01")
    assert D.kline7(b, "1900-01-01", "2100-01-01").count() == max(0, n - 7)
    assert D.horizon_samples(b, 7, every, every).count() == max(0, n - 13)
    assert D.horizon_samples(b, 5, every, every).count() == max(0, n - 11)


def test_scaler_of_a_constant_column_and_empty_window(spark):
    fitted = bars.fit_scaler(series(spark, 5, close=lambda i: 2.0), F.lit(True)).first()
    assert (fitted["open_lo"], fitted["open_hi"]) == (2.0, 2.0 + 1e-9)
    assert bars.fit_scaler(series(spark, 5), F.lit(False)).count() == 0


def test_prompt_text(spark):
    from marketloom.plans import datasets as D

    text = D.kline7(series(spark, 8), "1900-01-01", "2100-01-01").first()["prompt"]
    lines = text.split("\n")
    assert lines[0] == prompts.WEEK_HEADER and lines[1].startswith("Day1: open=0.0000") and "amplitude=3.25, pct_change=N/A" in lines[1] and lines[8] == "" and text.endswith(prompts.NEXT_DAY_TAIL)
    swapped = one(spark, prompts.think_prompt, text)
    assert swapped.endswith(prompts.NEXT_DAY_THINK_TAIL) and prompts.NEXT_DAY_TAIL not in swapped and swapped.startswith(prompts.WEEK_HEADER)


def test_asof_against_brute_force(spark):
    items = [(s, date(2026, 1, d), f"u{i}", i) for i, (s, d) in enumerate([("a", 1), ("a", 1), ("a", 5), ("b", 9), ("a", 20), ("a", 20)])]
    grid = [(s, date(2026, 1, d)) for s in ("a", "b", "c") for d in (1, 4, 5, 20, 31)]
    got = asof.topk_asof(spark.createDataFrame(grid, "symbol string, day date"), spark.createDataFrame(items, "symbol string, item_date date, url string, x int"), 2, max_age_days=15).collect()
    for r in got:
        wanted = sorted([(d, u) for s, d, u, _ in items if s == r["symbol"] and timedelta(0) <= r["day"] - d <= timedelta(15)], reverse=True)[:2]
        assert [(x["item_date"], x["url"]) for x in r["items"]] == wanted
    strict = asof.topk_asof(spark.createDataFrame([("a", date(2026, 1, 5))], "symbol string, day date"), spark.createDataFrame(items, "symbol string, item_date date, url string, x int"), 9, strict=True).first()
    assert len(strict["items"]) == 2


def test_merges_are_idempotent(spark):
    old = spark.createDataFrame([("u1", "a"), ("u2", "b")], "url string, title string")
    new = spark.createDataFrame([("u2", "B"), ("u3", "c"), ("u3", "d"), ("", "x"), (None, "y")], "url string, title string")
    once = merge.insert_if_absent(old, new, ["url"], "title")
    twice = merge.insert_if_absent(once, new, ["url"], "title")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [("u1", "a"), ("u2", "b"), ("u3", "c")]
    assert sorted(map(tuple, merge.upsert(old, new, ["url"], "title").collect())) == [("u1", "a"), ("u2", "B"), ("u3", "d")]
    assert merge.merge_counts(old, once) == {"before": 2, "after": 3, "added": 1, "deleted": 0}


def test_comment_retention(spark):
    rows = [(f"u{i:04}", f"p{i}", "s", "t", "2026-01-05 10:00:00" if i < 205 else "bad", str(i % 3), "0") for i in range(410)]
    kept = merge.retain_comments(spark.createDataFrame(rows, "url string, post_id string, symbol string, post_title string, publish_time string, click_count string, comment_count string"))
    assert kept.groupBy("publish_time").count().filter("count <> 200").count() == 0 and kept.count() == 400


def test_csv_round_trip_and_self_overwrite(spark, tmp_path):
    path = str(tmp_path / "news")
    assert readers.read_master(spark, path, "news").count() == 0
    rows = spark.createDataFrame([("u1", "000001", 'a "quoted"\ntitle, with comma', "2026-01-05"), ("u2", "00175", "", "")], "url string, symbol string, title string, date string")
    writers.write_master(rows, path, "news")
    back = readers.read_master(spark, path, "news")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    writers.write_master(merge.delete_by_key(back, rows.filter("url = 'u2'"), ["url"]), path, "news")
    assert [r["url"] for r in readers.read_master(spark, path, "news").collect()] == ["u1"]


def test_content_files(spark, tmp_path):
    (tmp_path / "news" / "2026-01").mkdir(parents=True)
    (tmp_path / "news" / "2026-01" / "a.txt").write_text("URL=http://x/?a=b\nTITLE=t\nTITLE=u\n---\nbody\n---\nmore\n")
    (tmp_path / "b.txt").write_text("no separator")
    parsed = {r["path"].rsplit("/", 1)[1]: r for r in readers.parse_content(readers.read_files(spark, str(tmp_path))).collect()}
    assert parsed["a.txt"]["metadata"] == {"URL": "http://x/?a=b", "TITLE": "u"} and parsed["a.txt"]["body"] == "body\n---\nmore" and parsed["b.txt"]["body"] is None
    with pytest.raises(Exception, match="no separator"):
        readers.parse_content(readers.read_files(spark, str(tmp_path)), strict=True).collect()


def test_universe_and_results(spark, tmp_path):
    (tmp_path / "u.json").write_text('{"sectors": {"x": [{"name": "n", "symbol": "000001", "market": " HK "}, {"name": "m", "symbol": "2"}], "y": [{"name": "n2", "symbol": "000001"}]}}')
    dim = readers.universe(spark, str(tmp_path / "u.json"))
    assert {(r["symbol"], r["market"], r["sector"]) for r in readers.all_symbols(dim).collect()} == {("000001", "hk", "x"), ("2", "a", "x")}
    (tmp_path / "r.jsonl").write_text('\nbroken\n{"custom_id":"1","response":{"status_code":200,"body":{"choices":[{"message":{"content":" a "}}]}}}\n{"custom_id":"1","response":{"status_code":500}}\n{"custom_id":"2","response":{"status_code":200,"body":{"choices":[]}}}\n{"response":{}}\n')
    assert {(r["custom_id"], r["completion"]) for r in readers.read_results(spark, str(tmp_path / "r.jsonl")).collect()} == {("1", ""), ("2", "")}


def test_stream_merges_late_rows(spark, tmp_path):
    landing, target = str(tmp_path / "in"), str(tmp_path / "table")
    for rows in ([("s", "2026-01-02", 1.0)], [("s", "2026-01-01", 2.0), ("s", "2026-01-02", 3.0)]):
        spark.createDataFrame(rows, "symbol string, trade_date string, close double").write.mode("append").parquet(landing)
        incremental.merge_stream(spark, landing, "symbol string, trade_date string, close double", target, ["symbol", "trade_date"], str(tmp_path / "cp"), mode="upsert").awaitTermination()
    assert sorted(map(tuple, Table(spark, target).read().collect())) == [("s", "2026-01-01", 2.0), ("s", "2026-01-02", 3.0)]


def test_page_marks(spark):
    rows = spark.createDataFrame([("3", 5), ("[1,3]", 5), ('{"completed": 5}', 5), ('{"completed": [1,2]}', 5), (None, 0), ('{"completed": [1], "total_pages": 5, "capped_at": 9}', 5)], "state string, total int")
    assert [r[0] for r in rows.select(incremental.next_page("state", "total")).collect()] == [4, 2, None, 3, None, None]


def test_html():
    page = '<html><body><div id="ContentBody"><p> one<b>x</b> </p><p></p><p>two &amp; three</p><script>var t="</p>"</script></div><div class="content"><p>a<br>b</p></div><a href="#">x</a><a href="/u"> t </a><a href="/u">again</a></body></html>'
    assert html.news_body(page) == "onex\n\ntwo & three" and html.report_body(page) == "a \n b" and html.links(page) == [("/u", "t")]
    assert html.generic_body("<p>short</p><p>" + "long enough text " * 3 + "</p>") == ("long enough text " * 3).strip() and html.news_body("") == "" and html.generic_body("<div><<<") == ""


def test_tokens_and_samples(spark):
    row = spark.createDataFrame([([1, 2, 3, 4, 5, 6], list(range(10, 14)))], "p array<int>, r array<int>").select(tokens.training_window(F.col("p"), F.col("r"), 8).alias("w")).first()["w"]
    assert row["input_ids"] == [3, 4, 5, 6, 10, 11, 12, 13] and row["labels"] == [-100] * 4 + [10, 11, 12, 13]
    ids = spark.range(1000)
    train, held = sampling.split(ids, "id", 0.1)
    assert train.count() + held.count() == 1000 and 50 < held.count() < 160 and sampling.sample(ids, "id", 7).count() == 7
    assert sampling.subset_size(1330, sampling.auto_ratio(500, 26338)) == 51


def test_scores(spark):
    rows = spark.createDataFrame([("涨，跌，涨", "涨，跌，涨"), ("涨，跌，涨", "涨，涨，涨"), ("涨，跌，涨", "提取失败")], "reference string, predicted string")
    got = scoring.triplet_accuracy(rows).first()
    assert abs(got["accuracy"] - 5 / 9) < 1e-9 and abs(got["accuracy_read"] - 5 / 6) < 1e-9
    empty = scoring.triplet_accuracy(rows.limit(0)).first()
    assert (empty["total"], empty["accuracy"]) == (0, 0.0)


def test_vendor_columns_and_fetch(spark):
    vendor = spark.createDataFrame([("2026-01-05", 1.0, 2.0, 3.0, 0.5, 9.0)], "`日期` string, `开盘` double, `收盘` double, `最高` double, `最低` double, `成交量` double")
    assert resolve_quotes(vendor, "000001").first()["turnover"] is None
    with pytest.raises(ValueError, match="lacks columns"):
        resolve_quotes(vendor.drop("收盘"))
    with pytest.raises(ValueError, match="lacks"):
        require_columns(vendor, ["prompt"])
    got = fetch.fetch(spark.createDataFrame([("a",), ("b",)], "symbol string"), lambda r: [{"symbol": r["symbol"], "n": 1}], "symbol string, n long")
    assert got.count() == 2
    waits = []
    with pytest.raises(ZeroDivisionError):
        fetch.with_retries(lambda: 1 / 0, 3, 1.0, sleep=waits.append)
    assert waits == [1.0, 2.0]


def test_searches_and_cached_pages(spark):
    found = fetch.searches(spark.createDataFrame([("000001", "甲")], "symbol string, name string")).collect()
    assert len(found) == 6 and found[5]["query"] == "000001 甲" and found[2]["query"] == "甲 公告"
    wanted = spark.createDataFrame([("a",), ("b",), ("b",)], "url string")
    cache = spark.createDataFrame([("a", "kept"), ("z", "other")], "url string, body string")
    got = fetch.cached_or_fetched(wanted, cache, "url", lambda r: [{"url": r["url"], "body": "new"}], "url string, body string")
    assert sorted(map(tuple, got.collect())) == [("a", "kept"), ("b", "new")]


def test_recent_quotes(spark):
    rows = [(f"202601{d:02d}", 1.0, 2.0, 3.0, 0.5, 9.0, 0.1) for d in range(1, 21)] + [("20251101", 1.0, 2.0, 3.0, 0.5, 9.0, 0.1)]
    vendor = spark.createDataFrame(rows, "trade_date string, open double, close double, high double, low double, vol double, pct_chg double")
    got = sorted(readers.recent_quotes(vendor, "2026-01-15", symbol="000001").collect(), key=lambda r: r["trade_date"])
    assert [str(r["trade_date"]) for r in got] == [f"2026-01-{d:02d}" for d in range(8, 15)] and got[0]["volume"] == 9.0 and got[0]["turnover"] is None
    assert readers.recent_quotes(vendor, "2025-12-01", symbol="000001").count() == 1


@pytest.mark.parametrize("workers, generations, wanted, expected", [(8, 4, 1, 1), (1, 8, 1, 8), (2, 8, 5, 8), (3, 4, 5, 8), (0, 4, 3, 3), (6, 4, 3, 4)])
def test_fitted_batch(workers, generations, wanted, expected):
    assert sampling.fitted_batch(workers, generations, wanted) == expected


def test_settings_file(tmp_path, monkeypatch):
    (tmp_path / "env").write_text("# note\nexport ML_A='x=1'\nML_B = \"two\"\nnothing\n\nML_C=3\n")
    monkeypatch.setenv("ML_C", "own")
    for name in ("ML_A", "ML_B"):
        monkeypatch.delenv(name, raising=False)
    assert load_env(str(tmp_path / "env")) == {"ML_A": "x=1", "ML_B": "two", "ML_C": "3"} and load_env(str(tmp_path / "none")) == {}
    assert (os.environ.pop("ML_A"), os.environ.pop("ML_B"), os.environ["ML_C"]) == ("x=1", "two", "own")


def test_batch_jobs(spark, tmp_path):
    class Service:
        state = "in_progress"

        def submit(self, path):
            return "j1"

        def status(self, job_id):
            return self.state

        def download(self, job_id, path):
            self.got = job_id, path

    service, state, out = Service(), str(tmp_path / "state"), str(tmp_path / "out")
    assert jobs.submit(spark, service, "requests", state) == "j1" and not jobs.collect_results(spark, service, state, out)
    service.state = "completed"
    assert jobs.collect_results(spark, service, state, out) and service.got == ("j1", out)
    assert tuple(Table(spark, state, "json").read().first()) == ("j1", "requests", "completed")
    service.state = "expired"
    with pytest.raises(RuntimeError, match="expired"):
        jobs.collect_results(spark, service, state, out)
