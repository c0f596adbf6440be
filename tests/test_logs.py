"""Appended tables, dataset files read back, and judgements of a model."""

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from marketloom.operators import content
from marketloom.plans import live
from marketloom.sources import fetch, readers, writers
from marketloom.sources.versions import Table


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_news_keep_the_order_in_which_they_came(spark, tmp_path):
    path = str(tmp_path / "news")
    news = lambda *urls: spark.createDataFrame([(u, "s", f"t {u}", "2026-01-01") for u in urls], "url string, symbol string, title string, date string")
    for batch in (("u5", "u9", ""), ("u1", "u9", "u1"), ("u3",)):
        writers.append_master(news(*batch), path, "news", "title")
    held = writers.master(spark, path).in_order()
    assert [r["url"] for r in held.orderBy("_appended", "url").collect()] == ["u5", "u9", "u1", "u3"]
    assert readers.read_master(spark, path, "news").count() == 4
    first = writers.master(spark, path).version(1).parts
    assert first.items() <= writers.master(spark, path).current().parts.items()  # what was there isn't written again


def test_the_feedback_log_takes_a_batch_once(spark, tmp_path):
    log = Table(spark, str(tmp_path / "log"))
    said = spark.createDataFrame([("s", date(2026, 1, 1), "{}", "涨"), ("t", date(2026, 1, 1), "{}", "跌")], "symbol string, day date, snapshot string, output string")
    came = spark.createDataFrame([("s", date(2026, 1, 1), "跌")], "symbol string, day date, label string")
    assert content.append_feedback(log, said, came, 0) and not content.append_feedback(log, said, came, 0) and content.append_feedback(log, said.limit(1), came, 1)
    assert rows(log.read().select("symbol", "output", "label")) == [("s", "涨", "跌"), ("s", "涨", "跌"), ("t", "跌", None)]


def test_dataset_files_are_read_back(spark, tmp_path):
    values = [(1, 'a "quoted", text', 0.5), (2, "two\nlines", None), (3, "", 1.0), (4, "涨，跌", 2.0), (5, "  blanks ", 3.0)]
    df = spark.createDataFrame(values, "i int, prompt string, score double")
    writers.write_dataset(df.repartition(2), str(tmp_path / "set"), "i")
    back = readers.read_dataset(spark, str(tmp_path / "set"), "prompt string, i int, score double, label string")
    assert [tuple(r) for r in back.orderBy("i").collect()] == [(p, i, s, None) for i, p, s in values]


def test_judgements_have_horizon_confidence_and_evidence(spark):
    bars = "kline array<struct<trade_date: string, open: double, close: double, high: double, low: double, change_amount: double, pct_change: double, volume: double, amount: double>>"
    df = spark.createDataFrame([(s, s, [("d", 1.0, 2.0, 3.0, 0.5, 1.0, 2.0, 9.0, 8.0)], "up", None, "") for s in ("good", "half", "bad")], f"symbol string, name string, {bars}, news_summary string, reports_summary string, serp_summary string")
    fine = [{"direction": "涨", "horizon": 1, "confidence": 0.7, "evidence": ["news"], "conflicts": []}, {"direction": "跌", "horizon": 7, "confidence": 1, "evidence": ["bars", "x"]}]
    half = [{"direction": "涨", "horizon": 3, "confidence": 0.2}, {"direction": "跌", "horizon": 3, "confidence": 0.4}, {"direction": "up", "horizon": 1, "confidence": 0.4}, {"direction": "涨", "horizon": 2, "confidence": 0.4}, {"direction": "涨", "horizon": 7, "confidence": 1.4}]

    def client(texts):
        assert all("horizon" in t for t in texts)
        return ["thoughts " + json.dumps(fine, ensure_ascii=False) + " end" if "good" in t else json.dumps(half, ensure_ascii=False) if "half" in t else "no idea" for t in texts]

    got = {(r["symbol"], r["horizon"]): (r["direction"], r["confidence"], r["evidence"]) for r in live.judged_predictions(df, client).collect()}
    assert got == {("good", 1): ("涨", 0.7, ["news"]), ("good", 7): ("跌", 1.0, ["bars", "x"]), ("half", 3): ("跌", 0.4, None), ("bad", None): ("提取失败", None, None)}
    assert live.judged_predictions(df.filter(F.lit(False)), client).count() == 0


def test_the_contract_of_text_models(spark):
    prompts = spark.createDataFrame([(i, None if i == 3 else f"p{i}") for i in range(10)], "i int, prompt string").coalesce(1)
    adapter = "lora"

    def client(texts):
        assert len(texts) <= 4
        return [f"{adapter}:{len(texts)}:{t}" for t in texts]

    got = {r["i"]: r["raw_output"] for r in fetch.generate(prompts, client, batch_size=4).collect()}
    assert got[0] == "lora:4:p0" and got[9] == "lora:2:p9" and got[3] == "lora:4:None" and len(got) == 10
    assert fetch.generate(prompts, lambda texts: iter(texts)).columns == ["i", "prompt", "raw_output"]
    with pytest.raises(Exception, match="4 prompts, but 3 answers"):
        fetch.generate(prompts, lambda texts: texts[1:], batch_size=4).collect()
    assert fetch.generate(prompts.limit(0), client).count() == 0
