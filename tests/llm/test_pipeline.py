import hashlib
import re

import corpus_pipeline
from pyspark.sql import functions as F

from marketloom.llm import bpe_codec, toxicity
from marketloom.llm.common import crc_bucket

from test_operators import plain_components

SMALL = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))


def groups_of(texts):
    """The group of each text by shared lines: equal texts, and those that share three quarters of their lines."""
    lines = {d: {x for x in t.split("\n") if x.strip(" ")} for d, t in texts.items()}
    group = {d: d for d in texts}

    def find(d):
        while group[d] != d:
            d = group[d]
        return d

    for d in texts:
        for e in texts:
            if d < e and (texts[d] == texts[e] or 4 * len(lines[d] & lines[e]) >= 3 * len(lines[d] | lines[e]) > 0):
                low, high = sorted((find(d), find(e)))
                group[high] = low
    return {d: find(d) for d in texts}


def run_lines(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    lines = dict(corpus_pipeline.STAGES)["line_dedup"](spark, docs, SMALL)
    return lines, {r["doc_id"]: r["text"] for r in lines.collect()}


def test_small_sources_lose_boilerplate_and_keep_copies(spark):
    own = {i: "\n".join(f"line {j} of text {i}" for j in range(8)) for i in range(12)}
    rows = [(i, "menu\n" + own[i], "three") for i in range(3)]
    rows += [(10, own[4], "pair"), (11, own[4], "pair"), (12, own[5], "pair")]
    rows += [(20, own[6], "near"), (21, own[6] + "\nand a line more", "near"), (22, own[7], "near"), (23, own[6].replace("line 3", "row 3"), "near")]
    rows += [(30, "menu\n" + own[8], "one"), (31, own[9], None), (32, "menu\n" + own[10], None), (33, "menu\n" + own[11], None)]
    lines, texts = run_lines(spark, rows)
    assert texts == {d: t if d in (30, 31) else t.removeprefix("menu\n") for d, t, _ in rows}
    kept = {r["doc_id"] for r in dict(corpus_pipeline.STAGES)["near_duplicates"](spark, lines, SMALL).collect()}
    assert kept == set(texts) - {11, 21, 23}


def test_copies_of_a_third_of_the_rows_leave_one(spark):
    copy = "\n".join(f"sentence {i} of a text that was copied over and over" for i in range(6))
    rows = [(i, copy if i % 3 == 0 else f"site menu of this source\nown text {i} " + " ".join(f"w{i}x{j}" for j in range(30)), "en", "s", 0) for i in range(90)]
    rows += [(100, copy + "!", "en", "s", 0), (101, "", "en", "s", 0), (102, None, "en", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    lines = stages["line_dedup"](spark, docs, SMALL)
    texts = {r["doc_id"]: r["text"] for r in lines.collect()}
    assert all(texts[d] == (copy if d % 3 == 0 else t.split("\n")[1]) for d, t, *_ in rows[:90])
    assert (texts[100], texts[101], texts[102]) == (copy + "!", "", None)
    kept = {r["doc_id"] for r in stages["near_duplicates"](spark, lines, SMALL).collect()}
    assert kept == {0, 101, 102} | {d for d in range(90) if d % 3}


def test_own_texts_under_a_long_shared_line_all_stay(spark):
    shared = " ".join(f"licence{j}" for j in range(120))
    own = {i: " ".join(f"own{i}x{j}" for j in range(15)) for i in range(40)}
    rows = [(i, f"{shared}\n{t}", "en", "s", 0) for i, t in own.items()] + [(i + 100, f"{shared}\n{own[i]}", "en", "s", 0) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    lines = stages["line_dedup"](spark, docs, SMALL)
    assert {r["doc_id"]: r["text"] for r in lines.collect()} == own | {i + 100: own[i] for i in range(3)}
    assert {r["doc_id"] for r in stages["near_duplicates"](spark, lines, SMALL).collect()} == set(own)


def test_near_duplicates_with_repeated_and_null_ids(spark):
    text = {x: " ".join(f"{x}{j}" for j in range(40)) for x in "abcd"}
    rows = [(1, text["a"]), (5, text["a"] + " more"), (5, text["b"]), (5, text["b"]), (5, None), (7, text["b"] + " more")]
    rows += [(None, text["a"]), (None, text["c"]), (None, text["c"]), (None, text["d"]), (None, ""), (None, None), (8, ""), (9, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r["doc_id"], r["text"]) for r in dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, SMALL).collect()]
    wanted = [(1, text["a"]), (5, text["b"]), (5, None), (None, text["c"]), (None, text["d"]), (None, ""), (None, None), (8, ""), (9, None)]
    assert sorted(map(str, kept)) == sorted(map(str, wanted))


def stages_of(spark, docs):
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
        yield name, docs


def test_stages_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for name, out in stages_of(spark, docs):
        assert out.count() == 0 and (name == "bpe" or out.columns == corpus_pipeline.COLUMNS)


def test_stages_with_null_columns_and_clashing_names(spark):
    own = " ".join(f"w{i}" for i in range(60))
    rows = [(None, None, None, None, None), (None, own, None, None, None), (1, own, "en", None, 9), (2, "", None, "s", None), (3, None, "en", "s", 0), (4, "x " * 60_000, "en", "s", 120_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("kept", "n_dropped", "key", "host", "lines", "score", "component_id", "row_key", "text_hash", "words", "ids"):
        docs = docs.withColumn(name, F.lit("clash"))
    counts = {name: out.count() for name, out in stages_of(spark, docs)}
    assert counts == {"toxicity": 6, "line_dedup": 6, "near_duplicates": 5, "decontamination": 5, "bpe": 5}  # of the two copies one stays


def test_run_removes_the_rows_of_earlier_stages(spark):
    import glob

    before = set(glob.glob(f"{spark.sparkContext.getCheckpointDir().removeprefix('file:')}/corpus-*")) if spark.sparkContext.getCheckpointDir() else set()
    corpus_pipeline.run(spark, SMALL).count()
    new = set(glob.glob(f"{spark.sparkContext.getCheckpointDir().removeprefix('file:')}/corpus-*")) - before
    assert [sorted(p.split("/")[-1] for p in glob.glob(f"{x}/*")) for x in new] == [["decontamination"]]


def test_each_stage_against_a_plain_version(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)

    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.fit(docs, labels.filter(crc_bucket("doc_id", 5) != 0))).collect()}
    clean = stages["toxicity"](spark, docs, SMALL)
    assert clean.columns == corpus_pipeline.COLUMNS and {r["doc_id"] for r in clean.collect()} == {d for d in rows if scores[d] < 0.5}

    sources = {r["doc_id"]: r["source"] for r in clean.collect()}
    total, holding = {}, {}
    group = groups_of({d: rows[d] for d in sources})
    for d, s in sources.items():
        total.setdefault(s, set()).add(group[d])
        for line in {x for x in rows[d].split("\n") if x.strip(" ")}:
            holding.setdefault((s, line), set()).add(group[d])
    lines = stages["line_dedup"](spark, clean, SMALL)
    texts = {r["doc_id"]: r["text"] for r in lines.collect()}
    for d, s in sources.items():
        gone = {x for x in rows[d].split("\n") if len(holding.get((s, x), ())) >= 2 and len(holding[s, x]) > 0.1 * len(total[s])}
        assert texts[d] == "\n".join(x for x in rows[d].split("\n") if x not in gone)

    near = stages["near_duplicates"](spark, lines, SMALL)
    kept = {r["doc_id"] for r in near.collect()}
    assert kept == {int(d) for d, _, c in plain_components(list(texts.items())) if d == c}

    windows = set()
    for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect():
        w = words(r["text"])
        windows |= {tuple(w[i : i + 10]) for i in range(max(len(w) - 9, 1))} if w else set()
    sizes = {len(w) for w in windows}
    dirty = {d for d in kept if any(tuple(w[i : i + n]) in windows for w in [words(texts[d])] for n in sizes for i in range(len(w) - n + 1))}
    pure = stages["decontamination"](spark, near, SMALL)
    assert {r["doc_id"] for r in pure.collect()} == kept - dirty and dirty

    codec = bpe_codec.Codec()
    for r in stages["bpe"](spark, pure, SMALL).collect():
        ids = codec.encode(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
    assert corpus_pipeline.run(spark, SMALL).count() == len(kept - dirty)
