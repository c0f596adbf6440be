"""Each training-data operator against a plain version, on small inputs with nulls, ties, repeats and odd columns."""

import functools
import hashlib
import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.llm import ann, bpe_codec, bpe_files, chat_format, chat_template, decontaminate, graph, jaccard_join, language_id, line_dedup, queries, substring_dedup, suffix_sort, token_counts, toxicity
from twins import same

SMALL = "/root/testdata/sf0.001"
ODD = ["", " \n\t", "one", "the cat sat on the mat and ran far away today", "the cat sat on the mat and ran far away today", "Été À LA PLAGE <|endoftext|> don't ΑΣ ß", "word " * 3000, "x" * 5000, "a\x1cb\x85c"]


@pytest.fixture(scope="module")
def docs(spark):
    """Odd documents: null and repeated ids, null texts, columns with the operators' own names."""
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, ODD[3]), (None, ODD[3]), (None, None), (50, None), (51, ODD[3] + " again")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("slot", "kind", "key", "host", "lines", "words", "cls", "n", "term", "score", "toxic_", "root", "block", "text_hash"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain_components(rows, percent=75):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted((str(d), len(sets[i]), str(least.get(find(i)) if sets[i] else d)) for i, (d, _) in enumerate(rows))


def near_copies(seed=1, groups=25, size=9):
    rng, rows = random.Random(seed), []
    words = ["w%d" % i for i in range(400)]
    for g in range(groups):
        base = [rng.choice(words) for _ in range(rng.choice([6, 40, 120]))]
        for _ in range(rng.randint(1, size)):
            text = list(base)
            for _ in range(rng.randint(0, 5)):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((len(rows), " ".join(text)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("blocks,short", [(512, 12), (3, 2)])
def test_jaccard_join(spark, docs, monkeypatch, blocks, short):
    monkeypatch.setattr(jaccard_join, "BLOCK_CLASSES", blocks)
    monkeypatch.setattr(jaccard_join, "SHORT_LIST", short)
    for df in (docs, spark.createDataFrame(near_copies(), "doc_id long, text string")):
        rows = [(r["doc_id"], r["text"]) for r in df.collect()]
        got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in jaccard_join.jaccard_join(df).collect())
        assert got == plain_components(rows)


def test_one_component_of_many_texts_and_copies(spark, monkeypatch):
    """A chain of near copies, each linked only with its neighbours, and hundreds of copies of one of them."""
    monkeypatch.setattr(jaccard_join, "BLOCK_CLASSES", 40)
    words = [f"v{i}" for i in range(700)]
    rows = [(1000 + i, " ".join(words[2 * i : 2 * i + 60])) for i in range(300)]
    rows += [(5000 + i, rows[7][1]) for i in range(400)] + [(9000 + i, f"other text number {i} " + " ".join(f"o{i}x{j}" for j in range(20))) for i in range(50)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_join(df).collect()}
    assert got == {d: 1000 if d < 9000 else d for d, _ in rows}


def plain_dedup(rows, length=50):
    ordered = [((1 << 62) if d is None else d, (t or "").encode()) for d, t in rows]
    first = {}
    for d, t in ordered:
        for p in range(len(t) - length + 1):
            first[t[p : p + length]] = min(d, first.get(t[p : p + length], d))
    out = []
    for d, t in ordered:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if first[t[p : p + length]] < d:
                gone[p : p + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((str(None if d == 1 << 62 else d), len(t), sum(gone), sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_substring_dedup(spark, docs):
    rng = random.Random(3)
    shared = ["".join(rng.choice("abc ") for _ in range(n)) for n in (49, 50, 51, 90, 400)]
    texts = [(i, "".join(rng.choice(shared) if rng.random() < 0.4 else "é%d" % rng.randrange(10**9) for _ in range(6))) for i in range(40)]
    for df in (docs, spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([(1, "ab" * 200), (2, "ba" * 200), (2, "ab" * 30)], "doc_id long, text string")):
        rows = [(r["doc_id"], r["text"]) for r in df.collect()]
        got = sorted((str(r["doc_id"]), *r[1:]) for r in substring_dedup.substring_dedup(df).collect())
        assert got == plain_dedup(rows)


def test_one_passage_in_every_document(spark):
    """Each amid other words: one anchor holds all documents."""
    rng = random.Random(12)
    passage = "this very passage stands in every single document of the corpus, word for word"
    rows = [(i, f"{rng.random()}" * 3 + passage + f"{rng.random()}" * 3) for i in range(150)] + [(200 + i, passage) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    got = sorted((str(r["doc_id"]), *r[1:]) for r in substring_dedup.substring_dedup(df).collect())
    assert got == plain_dedup(rows)


def test_substrings_without_equal_hash_are_not_sorted():
    hashes = np.array([5, 7, 5, 9, 7, 7, 5], np.uint64)
    assert suffix_sort.may_repeat(hashes, np.array([0, 0, 0, 0, 1, 1, 1])).tolist() == [0, 2, 4, 5]
    assert suffix_sort.may_repeat(hashes[:0], np.zeros(0, int)).tolist() == []


def test_suffix_sort_orders_by_content():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    starts, group = np.sort(rng.integers(0, 2900, 500)), np.sort(rng.integers(0, 5, 500))
    compare = suffix_sort.Comparer(data, starts, np.full(500, 40))
    order = suffix_sort.sort_groups(compare, group)
    text = lambda i: data[starts[i] : starts[i] + 40].tobytes()
    assert order.tolist() == sorted(range(500), key=lambda i: (group[i], text(i), i))
    # A collision of hashes is not taken for a match.
    compare.hashes[:] = 7
    runs = suffix_sort.equal_runs(compare, group)
    assert all((runs[a] == runs[b]) <= (text(a) == text(b)) for a, b in zip(order, order[1:]))


def test_tokens_equal_the_library(spark, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe_files.default_path())
    rows = docs.select("doc_id", "text").collect()
    wanted = [(str(r["doc_id"]), library.encode(r["text"] or "", add_special_tokens=False).ids) for r in rows]
    assert sorted((str(r[0]), r[2]) for r in token_counts.token_counts(docs).collect()) == sorted((d, len(i)) for d, i in wanted)
    ids = bpe_codec.encode(docs)
    assert sorted((str(r[0]), r[1]) for r in ids.collect()) == sorted(wanted)
    assert sorted((str(r[0]), r[1]) for r in bpe_codec.decode(ids).collect()) == sorted((d, library.decode(i, skip_special_tokens=False)) for d, i in wanted)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert sorted((str(r[0]), *r[1:]) for r in bpe_codec.round_trip_digests(docs).collect()) == sorted((d, len(i), sha(" ".join(map(str, i))), sha(library.decode(i, skip_special_tokens=False))) for d, i in wanted)


def test_pieces_are_merged_once_in_any_case_and_company():
    from tokenizers import Tokenizer

    library, codec = Tokenizer.from_file(bpe_files.default_path()), bpe_codec.Codec()
    shown = bpe_codec.Shown(codec)
    assert shown.text("Erbleha ERBLEHA, erbleha")[0].count(" ") == len(codec.encode("erbleha erbleha, erbleha")) and set(shown) == {"erbleha", "erbleha,", ","}
    odd = ["", " \x1c ", "a\x1cb\x85c", "x<|endoftext|>y", "<|ENDOFTEXT|> <|endoftext|>É", "ΣΑΣ ΑΣ.", "e\u0301te\u0301 E\u0301", "İI\u0307", "don't WE'LL ''s '", "１２ ab12", "aaaa" * 400, "Å\u2000\u0301"]
    for text in odd + [" ".join(odd)]:
        ids = library.encode(text, add_special_tokens=False).ids
        assert codec.encode(text) == ids
        assert shown.text(text) == ("".join(f" {i}" for i in ids), "".join(f" {library.id_to_token(i)}" for i in ids)), text


def test_long_lines_without_blanks_are_counted_in_time():
    import time

    rng = random.Random(7)
    known = token_counts.PieceCounts(bpe_files.default_path())
    symbols = lambda text: known.vocabulary.symbols(text)
    for letters in ("ab", "a", "abcdefghijklmnopqrstuvwxyz", "acgt", "eestanrio"):
        for n in (1, 2, 3, 40, 300, 2500):
            text = "".join(rng.choice(letters) for _ in range(n))
            assert token_counts.surviving_long(symbols(text), known.table) == token_counts.surviving([symbols(text)], known.table)[0]
    library = bpe_codec.Codec()
    for letters in ("abcdefghijklmnopqrstuvwxyz", "ACGT", "abcABC123+/"):
        text = "".join(rng.choice(letters) for _ in range(20_000))
        known.learn([text])
        assert known[text] == len(library.encode(text))
    began = time.perf_counter()
    known.learn(["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000))])
    assert time.perf_counter() - began < 60


def test_template_language():
    render = lambda source, **v: [p for p in chat_template.compile_template(source)(v)]
    assert "".join(t for t, _ in render("{% for x in xs %}{% if x.a == 'b' and not x.c %}1{% elif x.a %}2{% else %}{{ 'z' + x.d | upper }}{% endif %}{% endfor %}", xs=[{"a": "b"}, {"a": "q"}, {"d": "e"}])) == "12zE"
    assert chat_template.fold(chat_template.parse("a{{ 'b' + 'c' }}{% if 'x' == 'y' %}no{% else %}d{% endif %}")) == [chat_template.Text("abcd")]
    assert render("{% generation %}{{ x }}{% endgeneration %}.", x="a") == [("a", True), (".", False)]
    for bad in ("{% for x %}{% endfor %}", "{{ x | nope }}", "{% if x %}", "{{ x( }}", "{% import os %}"):
        with pytest.raises(chat_template.TemplateError):
            chat_template.compile_template(bad)
    assert render("{{ x.__class__ }}", x="s") == [("", False)]


def test_chat_round_trip(spark):
    texts = [r"\### Assistant: </turn> ok", "</turn>\n### User: hi", "\\", "\\\\</turn>", "####", "", None, "é\n"]
    rows = [(c, t, role, texts[(c + t) % len(texts)]) for c in range(8) for t, role in enumerate(["system", "user", "assistant", "to: ol\\", None])] + [(None, 0, "assistant", "x"), (1, 1, "user", "again")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    got = {r["conv_id"]: r for r in chat_format.chat_digests(df).collect()}
    for c in {r[0] for r in rows}:
        own = sorted(((t, role or "", text or "") for i, t, role, text in rows if i == c))
        assert got[c]["n_turns"] == len(own)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in own).encode()).hexdigest()
        said = "".join(t for _, r, t in own if r == "assistant")
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    full = {r["conv_id"]: r for r in chat_format.chat_format(df).collect()}
    assert all(len(full[c]["formatted"]) == got[c]["formatted_chars"] for c in got)
    assert chat_format.chat_digests(df.limit(0)).count() == 0


def test_decontamination(spark, docs):
    items = spark.createDataFrame([(7, "SAT on the mat; and ran far away today"), (12, "one"), (13, None), (14, ""), (9, "never seen words"), (12, "word word")], "item_id long, text string").withColumn("words", F.lit(1))
    got = {(r["doc_id"], r["n_words"]): r for r in decontaminate.decontaminate(docs, items).collect()}
    assert decontaminate.decontaminate(docs, items).count() == docs.count()
    assert got[3, 11]["n_hit"] == 9 and got[3, 11]["item_ids"] == ["7"] and got[51, 12]["item_ids"] == ["7"]
    assert got[2, 1]["item_ids"] == ["12"] and got[6, 3000]["n_hit"] == 3000 and got[0, 0]["n_hit"] == 0 and got[50, 0]["n_items"] == 0
    near = decontaminate.Index(docs, spark.createDataFrame([(1, "mat sat")], "item_id long, text string")).proximity_matches(5)
    assert {r["doc_id"] for r in near.collect()} == {3, 4, 51, None}
    assert decontaminate.decontaminate(docs, items.limit(0)).filter("n_hit > 0").count() == 0 and decontaminate.decontaminate(docs.limit(0), items).count() == 0


def plain_windows(items, width=10):
    out = {}
    for i, t in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t or ""))
        for s in range(max(len(w) - width + 1, 1)) if w else ():
            out.setdefault(tuple(w[s : s + width]), set()).add(str(i))
    return out


def plain_hits(docs, items):
    """(doc_id, start, window) of every occurrence, repeated rows once."""
    windows = plain_windows(items)
    sizes = {len(w) for w in windows}
    out = set()
    for d, t in docs:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t or ""))
        out |= {(d, s, tuple(w[s : s + n])) for n in sizes for s in range(len(w) - n + 1) if tuple(w[s : s + n]) in windows}
    return out


@pytest.mark.parametrize("limit", [0, 4_000_000])
def test_decontamination_paths_agree(spark, docs, monkeypatch, tmp_path, limit):
    """Broadcast, shuffled and stored: long documents, a word that is everywhere, windows of frequent words alone."""
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", limit)
    rng = random.Random(8)
    words = ["the"] * 12 + ["w%d" % i for i in range(60)]
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([3, 40, 4000 if i == 5 else 60])))) for i in range(40)]
    passages = [(i, " ".join(texts[i][1].split()[s : s + n])) for i, s, n in ((0, 3, 12), (5, 1000, 30), (7, 0, 4), (5, 3990, 10), (9, 20, 10))]
    items = passages + [(50, "the the"), (51, None), (52, "never " * 11)]
    df = spark.createDataFrame(texts + texts[:2] + [(None, texts[3][1]), (4, texts[5][1])], "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    rows, bench = [(r["doc_id"], r["text"]) for r in df.collect()], spark.createDataFrame(items, "item_id long, text string")
    wanted = plain_hits(rows, items)
    index = decontaminate.Index(df, bench)
    windows = {r["win_id"]: tuple(r["window"]) for r in index.windows.collect()}
    assert index.is_small == (limit > 0)
    assert {(r["doc_id"], r["start"], windows[r["win_id"]]) for r in index.phrase_matches().collect()} == wanted
    path = str(tmp_path / "postings")
    decontaminate.write_postings(df, path)
    stored = decontaminate.StoredIndex(spark.read.parquet(path), bench)
    assert {(r["doc_id"], r["start"], windows[r["win_id"]]) for r in stored.phrase_matches().collect()} == wanted
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["item_ids"]) for r in decontaminate.decontaminate(df, bench).collect())
    holds, plain = plain_windows(items), []
    for d, t in rows:
        own, n = plain_hits([(d, t)], items), len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t or "")))
        plain.append((str(d), n, len({s + k for _, s, w in own for k in range(len(w))}), sorted({i for _, _, w in own for i in holds[w]})))
    assert got == sorted(plain)


def test_large_test_sets_shuffle_no_word_arrays(spark, docs, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    index = decontaminate.Index(docs, spark.createDataFrame([(1, "the cat sat")], "item_id long, text string"))
    plan = index.phrase_matches()._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in plan.split("\n") if "Join Inner" in x and "salt" in x]
    assert joins and "words" not in "".join(x for x in plan.split("\n") if "Exchange" in x)
    assert [c for c in index.postings(index.rarest()).columns if c == "words"] == []


def test_proximity_matches_against_a_plain_search(spark):
    rng = random.Random(3)
    texts = [(i, " ".join(rng.choice("abcdefgh") for _ in range(60))) for i in range(25)]
    df, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([(1, "a b"), (2, "c zz"), (3, "d e")], "item_id long, text string")
    index = decontaminate.Index(df, bench)
    rare = {}
    for r in index.rarest().collect():
        rare.setdefault(r["win_id"], {})[r["slot"]] = r["term"]
    wanted = set()
    for d, t in texts:
        w = t.split()
        for win, slots in rare.items():
            for p, x in enumerate(w):
                if x == slots[1] and (near := [q for q in range(max(p - 2, 0), min(p + 3, len(w))) if w[q] in slots.values()]) and {w[q] for q in near} == set(slots.values()):
                    wanted.add((d, win, min(near), max(near)))
    assert {(r["doc_id"], r["win_id"], r["first"], r["last"]) for r in index.proximity_matches(2).collect()} == wanted and wanted


def test_line_dedup(spark, docs):
    rows = [(i, "h", [f"own {i}", "menu", ""] if i < 9 else [f"own {i}"]) for i in range(20)] + [(100, "g", ["menu"]), (None, "h", ["menu", "x"]), (101, "h", None)]
    got = {r["key"]: r for r in line_dedup.line_dedup(spark.createDataFrame(rows, "key long, host string, lines array<string>")).collect()}
    assert got[0]["kept"] == ["own 0", ""] and got[0]["n_dropped"] == 1 and got[100]["kept"] == ["menu"] and got[None]["kept"] == ["x"] and got[101]["kept"] is None
    pages = spark.createDataFrame([(1, "HTTPS://A.b:80/x", "<p>x<b>y</b></p><script>z</script> w <br>v"), (2, None, None)], "page_id long, url string, html string")
    assert {(r["host"], tuple(r["lines"])) for r in line_dedup.page_lines(pages).collect()} == {("a.b", ("xy", "w", "v")), ("", ())}


def test_line_dedup_of_small_and_nameless_hosts_with_clashing_columns(spark):
    rows = [(1, None, ["menu", "a"]), (2, None, ["menu", "b"]), (3, "", ["menu"]), (4, "s", ["foot", "c"]), (5, "s", ["foot", "foot"]), (6, "t", ["foot", "long " * 9000])] + [(10 + i, "u", [f"x{i}", "once" if i < 2 else "y"]) for i in range(40)]
    df = spark.createDataFrame([(*r, "in", 7, "d") for r in rows], "key long, host string, lines array<string>, kept string, n_dropped int, dropped string").withColumn("hashes", F.lit(1)).withColumn("d", F.lit(2))
    out = line_dedup.line_dedup(df)
    got = {r["key"]: (r["kept"], r["n_dropped"], r["dropped"], r["host"]) for r in out.collect()}
    assert got[1] == (["a"], 1, "d", None) and got[2] == (["b"], 1, "d", None) and got[3] == ([], 1, "d", "")
    assert got[4] == (["c"], 1, "d", "s") and got[5] == ([], 2, "d", "s") and got[6][:2] == (["foot", "long " * 9000], 0)
    assert got[10][:2] == (["x0", "once"], 0) and got[49][:2] == (["x39"], 1)  # 2 of 40 pages are under the ratio
    assert sorted(out.columns) == sorted(df.columns) and line_dedup.line_dedup(df.limit(0)).count() == 0 and line_dedup.line_dedup(df, distinct=True).count() == len(rows)


def test_equal_pages_and_groups_count_once(spark):
    rows = [(1, "h", ["a", "b"]), (2, "h", ["a", "b"]), (3, "h", ["c"]), (4, "g", ["a", "x"]), (5, "g", ["a", "y"]), (6, "g", ["z"])]
    df = spark.createDataFrame(rows, "key long, host string, lines array<string>")
    kept = lambda **more: {r["key"]: r["kept"] for r in line_dedup.line_dedup(df, **more).collect()}
    assert kept()[1] == [] and kept(distinct=True) == {1: ["a", "b"], 2: ["a", "b"], 3: ["c"], 4: ["x"], 5: ["y"], 6: ["z"]}
    pair = df.filter("key in (4, 5)").select(line_dedup.text_hash("lines").alias("text_hash"), F.lit(1).cast("long").alias("grp"))
    assert kept(groups=pair) == {k: lines for k, _, lines in rows}


def test_nearest(spark):
    rng = np.random.default_rng(1)
    points = rng.standard_normal((600, 16)) * rng.uniform(0.5, 2, (600, 1))
    points[300:340] = points[300]
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(points)] + [(1000, None), (1020, [0.0] * 16), (1040, [float("nan")] * 16), (1060, [1.0] * 3), (None, [1.0] * 16), (1080, [None] + [1.0] * 15)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("bucket", F.lit("clash"))
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 600, 20)) and all(len(v) == 20 for v in got.values())
    hits = 0
    for q, found in got.items():
        scores = (points * points[q]).sum(axis=1)
        best = sorted((i for i in range(600) if i != q), key=lambda i: (-scores[i], i))[:20]
        hits += len(set(best) & {i for i, _ in found})
        assert found == sorted(found, key=lambda x: (-x[1], x[0])) and all(abs(s - scores[i]) < 1e-12 for i, s in found)
    assert hits / (20 * len(got)) >= 0.9
    few = ann.nearest(df.filter("vec_id < 5"), F.col("vec_id") % 20 == 0).collect()
    assert len(few) == 4 and ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_nearest_of_uneven_norms(spark):
    rng = np.random.default_rng(5)
    points = rng.standard_normal((2000, 32))
    points /= np.linalg.norm(points, axis=1)[:, None]
    longer = np.ones(2000)
    longer[7] = 3
    for norms in (longer, rng.lognormal(0, 0.5, 2000)):
        uneven = points * norms[:, None]
        df = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(uneven)], "vec_id long, embedding array<double>")
        got = {}
        for r in ann.nearest(df, F.col("vec_id") % 20 == 0).collect():
            got.setdefault(r["query_id"], set()).add(r["vec_id"])
        hits = 0
        for q in range(0, 2000, 20):
            scores = uneven @ uneven[q]
            scores[q] = -np.inf
            hits += len(got[q] & set(np.argsort(-scores, kind="stable")[:20].tolist()))
        assert hits / 2000 >= 0.93


def test_probes_come_in_order_of_success():
    from itertools import product

    rng = np.random.default_rng(9)
    inside = rng.uniform(0, 1, (12, 5))
    for x, found in zip(inside, ann.probe_order(inside, 18)):
        costs = {step: sum({-1: p**2, 0: 0, 1: (1 - p) ** 2}[s] for s, p in zip(step, x)) for step in product((-1, 0, 1), repeat=5)}
        assert np.allclose([costs[tuple(s)] for s in found.tolist()], sorted(costs.values())[:18])
    assert ann.probe_order(rng.uniform(0, 1, (3, 40)), 18).shape == (3, 18, 40)  # no list of all perturbations


def test_nearest_with_repeated_ids(spark):
    rng = np.random.default_rng(3)
    points = rng.standard_normal((1500, 8))
    rows = [(i, p.tolist()) for i, p in enumerate(points)]
    other = [(7, [9.0] * 8), (40, [-9.0] * 8), (41, points[41].tolist())]
    one = {i: min(v for j, v in rows + other if j == i) for i, _ in rows}
    df = spark.createDataFrame(rows + other, "vec_id long, embedding array<double>")
    found = ann.nearest(df, F.col("vec_id") % 500 == 0).collect()
    assert len(found) == 60 and len({(r["query_id"], r["vec_id"]) for r in found}) == 60
    assert all(abs(r["score"] - np.dot(one[r["query_id"]], one[r["vec_id"]])) < 1e-9 for r in found)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_recall_on_the_tables_own_vectors(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    rows = df.select("vec_id", "embedding").toArrow()
    ids, points = rows.column("vec_id").to_numpy(), np.array(rows.column("embedding").to_pylist(), np.float64)
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q in got:
        scores = points @ points[ids == q][0]
        scores[ids == q] = -np.inf
        hits += len(got[q] & set(ids[np.argsort(-scores, kind="stable")[:20]].tolist()))
    assert set(got) == {int(i) for i in ids if i % 20 == 0} and hits / (20 * len(got)) >= 0.9


def test_clustered_vectors_are_searched_in_few_cells():
    """Of vectors that have near neighbours a query visits few; the tables' own are spread evenly in 64 dimensions, where
    no width finds nine in ten neighbours without visiting most rows (README)."""
    rng = np.random.default_rng(12)
    shares = []
    for n in (2000, 8000):
        centres = rng.standard_normal((n // 40, 64))
        points = centres[rng.integers(0, len(centres), n)] + 0.35 * rng.standard_normal((n, 64))
        points /= np.linalg.norm(points, axis=1)[:, None]
        asked = np.arange(0, n, n // 100)
        scores = points[asked] @ points.T
        scores[np.arange(len(asked)), asked] = -np.inf
        near = np.argsort(-scores, axis=1)[:, :20]
        members, seekers = ann.as_members(points, 1.0), ann.as_seekers(points[asked])
        width = ann.tuned_width(seekers, np.repeat(np.arange(len(asked)), 20), members[near.ravel()], 0, ann.TABLES, ann.HASHES, 0.5, ann.PROBES)
        visited = np.zeros(scores.shape, bool)
        for t in range(ann.TABLES):
            place = ann.cells(seekers, t, ann.HASHES, width)
            home = np.floor(place)
            own, probed = ann.bucket_keys(np.floor(ann.cells(members, t, ann.HASHES, width))), ann.bucket_keys(home[:, None, :] + ann.probe_order(place - home, ann.PROBES))
            for row, keys in zip(visited, probed):
                row |= np.isin(own, keys)
        assert np.take_along_axis(visited, near, 1).mean() >= 0.9
        shares.append(visited.mean())
    assert shares[0] < 0.2 and shares[1] < 0.2


def plain_stems(text):
    """Counts of the first four letters of each word; each letter without case begins a term of two."""
    out, low = {}, text.lower()
    kind = [unicodedata.category(c) for c in low] + ["Zs"] * 4
    for i, c in enumerate(low):
        if kind[i][0] not in "LM" or i and kind[i - 1][0] in "LM" and kind[i] != "Lo":
            continue
        n = 1
        while n < (2 if kind[i] == "Lo" else 4) and kind[i + n][0] in "LM":
            n += 1
        out[low[i : i + n]] = out.get(low[i : i + n], 0) + 1
    return out


def plain_vectors(texts, examples):
    """TF-IDF vectors; terms that no example holds share the document frequency of their slot."""
    known = {t for e in examples for t in plain_stems(e or "")}
    slot = functools.cache(lambda t: t if t in known else int(toxicity.stems([t])[1][0]) % toxicity.OTHER)
    df, out = {}, []
    counts = [plain_stems(t or "") for t in texts]
    for c in counts:
        for t in {slot(t) for t in c}:
            df[t] = df.get(t, 0) + 1
    for c in counts:
        v = {k: n * np.log(len(texts) / df[slot(k)]) ** toxicity.IDF_POWER for k, n in c.items()}
        length = np.sqrt(sum(x * x for x in v.values())) or 1.0
        out.append({k: x / length for k, x in v.items()})
    return out


def test_stems_are_those_of_whole_texts(monkeypatch):
    monkeypatch.setattr(toxicity, "STRETCH", 40)
    rows = ["", "Straße İstanbul ΣΑΣ o'clock", "a" * 200 + " tail", "日本語のテキスト and more", "word " * 100, "x1y2 \n\t", "कखगघ e\u0301te\u0301s"]
    seen = 0
    for begin, end, row, term, n in toxicity.counted(rows):
        for i in range(begin, end):
            wanted = plain_stems(rows[i])
            # Hashes of the terms themselves: a term alone is a text.
            one = {int(h): wanted[t] for t in wanted for h in toxicity.stems([t])[1][:1]}
            assert dict(zip(term[row == i - begin].tolist(), n[row == i - begin].tolist())) == one
            seen += 1
    assert seen == len(rows)


def test_toxicity_model_against_brute_force(spark):
    """Fit, cosines, order, votes and calibration on a whole table."""
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    label = {r["doc_id"]: float(r["toxic"]) for r in labels.collect()}
    model = toxicity.fit(df, labels)
    assert set(model.ids.tolist()) == set(label) & set(texts)  # every labelled row is indexed
    vector = dict(zip(texts, plain_vectors(list(texts.values()), [texts[d] for d in label])))
    k, ids = model.k, model.ids.tolist()

    def nearest(d, among):
        cosines = {e: sum(w * vector[e].get(t, 0) for t, w in vector[d].items()) for e in among}
        return sorted(((round(c, 5), e) for e, c in cosines.items() if c > 1e-6), reverse=True)[:k]

    def share(near):
        return sum(c * label[e] for c, e in near) / sum(c for c, _ in near)

    own = [nearest(d, [e for e in ids if e != d]) for d in ids]
    x, y = np.array([share(n) for n in own if n]), np.array([label[d] for d, n in zip(ids, own) if n])
    curve = toxicity.isotonic(x, y, model.base)
    for r in toxicity.score(df, model).collect():
        near = nearest(r["doc_id"], ids)
        assert np.allclose([c for c, _ in near[:5]], r["cosines"], atol=2e-5) and len(r["evidence"]) == min(5, len(near))
        assert all(abs(sum(w * vector[e].get(t, 0) for t, w in vector[r["doc_id"]].items()) - c) < 2e-5 for e, c in zip(r["evidence"], r["cosines"]))
        assert abs(np.interp(share(near), *curve) - r["score"]) < 0.02 if near else r["score"] == model.bare
    # The curve is the least-squares rising one: it meets the means of its own pools.
    at, value = toxicity.isotonic(np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.0, 1.0, 0.0, 1.0]), 0.5)
    assert np.allclose(at, [0.1, 0.25, 0.4]) and np.allclose(value, [0.25, 0.5, 0.75])


def test_block_max_search_is_exact(monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", 8)
    rng = np.random.default_rng(4)
    size = rng.integers(0, 12, 700)
    term = np.concatenate([rng.choice(60, n, replace=False) for n in size]).astype(np.uint64)
    model = toxicity.Model(np.arange(60, dtype=np.uint64), np.concatenate([np.linspace(0.5, 3, 60), np.ones(toxicity.OTHER)]), 0.3, 0.3)
    model = toxicity.indexed(model, np.arange(700), rng.integers(0, 2, 700).astype(float), size, term, rng.integers(1, 4, len(term)))
    full = np.zeros((700, len(model.idf)))
    full[np.repeat(np.arange(700), np.diff(np.append(0, model.ends))), model.terms] = model.weights
    asked = [np.sort(rng.choice(60, rng.integers(0, 5), replace=False)) for _ in range(80)]
    row, place = np.repeat(np.arange(80), [len(q) for q in asked]), np.concatenate(asked)
    weight = model.weighed(row, place, np.ones(len(place)), 80)
    for share in (0.02, 0.2, 1.0):
        monkeypatch.setattr(toxicity, "FREQUENT", share)
        near, cosines = toxicity.Index(model).nearest(row, place, weight, 80, 15)
        for q in range(80):
            wanted = full[:, place[row == q]] @ weight[row == q] if (row == q).any() else np.zeros(700)
            assert np.allclose(np.sort(wanted)[::-1][:15], cosines[q], atol=1e-5)
            assert all(abs(wanted[i] - c) < 1e-5 for i, c in zip(near[q], cosines[q]) if c > 0)


def test_toxicity(spark, docs):
    rows = [(i, ("plain words here again " * 3) + ("awful" if i % 2 else "")) for i in range(60)] + [(90, None), (91, ""), (92, "awful"), (49, "other text"), (49, "other text")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] + [(48, 0), (51, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(df, labels)
    assert len(model.ids) == 51 and model.ids.tolist().count(49) == 2
    got = {r["doc_id"]: r["score"] for r in toxicity.score(df, model).collect()}
    assert got[55] > 0.9 and got[56] < 0.5 and got[90] == got[91] == model.bare and got[92] > 0.9
    assert toxicity.score(docs, toxicity.fit(df, labels.limit(0))).filter("score = 0").count() == docs.count()
    assert {r["score"] for r in toxicity.score(docs, toxicity.fit(df, labels.filter("toxic = 1"))).collect()} == {1.0}
    assert toxicity.score(df.limit(0), model).count() == 0 and toxicity.fit(df.limit(0), labels).base == 0
    assert {r["doc_id"] for r in toxicity.without_toxic(df, model).collect()} == {i for i in got if got[i] < 0.5}
    assert len(toxicity.fit(df, labels, n_examples=20).ids) <= 20


def test_language(spark, docs):
    rows = [(i, "the cat and the dog of this house " * 3 if i % 2 else "le chat et le chien de cette maison " * 3, "en" if i % 2 else "fr") for i in range(40)]
    model = language_id.fit(spark.createDataFrame(rows + [(99, None, "de"), (98, "x", None)], "doc_id long, text string, lang string"))
    probe = spark.createDataFrame([(1, "the dog and the house"), (2, "le chien et la maison"), (3, None), (4, "12 !?"), (5, "the " * 9000)], "doc_id long, text string").withColumn("lang", F.lit("xx"))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(probe, model).collect()}
    assert got[1][0] == got[5][0] == "en" and got[2][0] == "fr" and got[3] == got[4] == ("und", 0.0)
    assert language_id.identify(docs, language_id.fit(probe.limit(0))).filter("lang_pred <> 'und'").count() == 0
    assert language_id.codewords(1).shape == (1, 0) and language_id.codewords(20).shape[0] == 20


def plain_language(training, probes):
    """Counts, classifiers, bit weights and decoding, text by text."""
    def grams(t):
        data = language_id.FOLD[np.frombuffer(b" " + t.encode() + b"  ", np.uint8)].astype(np.uint64)
        return [int((int(a) * 0x9E3779B1 + int(b) * 0x85EBCA6B + int(c) * 0xC2B2AE35) % (1 << 32) >> 17) for a, b, c in zip(data, data[1:], data[2:])]

    names = sorted({x for _, x in training})
    code, odds = language_id.codewords(len(names)), np.full((len(names), language_id.GRAMS), 0.5)
    for t, x in training:
        for g in grams(t):
            odds[names.index(x), g] += 1
    odds /= odds.sum(axis=1, keepdims=True)
    weights = np.array([[np.log(odds[c > 0, g].mean() / odds[c < 0, g].mean()) for g in range(language_id.GRAMS)] for c in code.T])
    margin = lambda t: np.array([np.mean([w[g] for g in grams(t)]) if grams(t) else 0 for w in weights])
    trust = np.array([[(sum(margin(t)[b] * code[k, b] > 0 for t, x in training if x == name) + 1) / (sum(x == name for _, x in training) + 2) for b in range(code.shape[1])] for k, name in enumerate(names)])
    trust /= trust.mean(axis=1, keepdims=True)
    out = []
    for t in probes:
        loss = [(np.log1p(np.exp(-margin(t) * code[k] * language_id.SHARPNESS)) * trust[k]).sum() for k in range(len(names))]
        share = np.exp(min(loss) - np.array(loss))
        out.append((names[int(np.argmin(loss))], share.max() / share.sum()))
    return out


def test_language_against_a_plain_decoder(spark):
    rng = random.Random(2)
    syllables = {"en": ["the ", "and ", "ing ", "of "], "fr": ["le ", "et ", "ment ", "é "], "de": ["der ", "und ", "ß ", "keit "]}
    training = [("".join(rng.choice(syllables[x]) for _ in range(rng.randint(1, 12))), x) for x in syllables for _ in range(6)]
    probes = ["".join(rng.choice(syllables[rng.choice("en fr de".split())]) for _ in range(8)) for _ in range(20)]
    df = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(training)], "doc_id long, text string, lang string")
    asked = spark.createDataFrame(list(enumerate(probes)), "doc_id long, text string")
    for parts in (1, 7):  # the model doesn't depend on partitions
        found = language_id.identify(asked, language_id.fit(df.repartition(parts))).orderBy("doc_id").collect()
        for r, (name, share) in zip(found, plain_language(training, probes)):
            assert r["lang_pred"] == name and abs(r["score"] - share) < 1e-4
    assert language_id.identify(asked.limit(0), language_id.fit(df)).count() == 0


def test_reading_back_is_linear_in_the_text():
    import time

    text = "</turn>\n" * 1_000_000  # 8 MB of end marks
    seen, began = [], time.perf_counter()
    pieces = chat_template.compile_template(chat_template.DEFAULT_TEMPLATE)({"messages": [{"role": "user", "text": text}, {"role": "a: " * 100_000, "text": "x"}]})
    chat_template.read_turns(pieces, lambda role, t: seen.append((role, t)), lambda t: None)
    assert seen == [("user", text), ("a: " * 100_000, "x")] and time.perf_counter() - began < 60


def test_end_marks_parted_between_pieces():
    whole = "### User: a\\</turn> b</turn>\n### User: c</turn>\n"
    for size in (1, 2, 3, 7):
        seen = []
        n = chat_template.read_turns(((whole[i : i + size], False) for i in range(0, len(whole), size)), lambda role, t: seen.append((role, t)), lambda t: None)
        assert seen == [("user", "a</turn> b"), ("user", "c")] and n == len(whole)


def test_a_cluster_without_shared_folder_is_refused():
    from types import SimpleNamespace

    from marketloom.llm.common import ensure_checkpoint_dir

    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(ValueError):
        ensure_checkpoint_dir(SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *a: None)))


def test_components(spark):
    links = spark.createDataFrame([(9, 8), (8, 7), (7, 6), (6, 5), (1, 2), (3, 2), (4, 4), (5, 9)], "a long, b long")
    assert {(r["node"], r["root"]) for r in graph.components(links).collect()} == {(i, 5) for i in range(5, 10)} | {(i, 1) for i in (1, 2, 3)}


def union_find(links):
    parent = {x: x for link in links for x in link if link[0] != link[1]}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            low, high = sorted((find(a), find(b)))
            parent[high] = low
    return sorted((x, find(x)) for x in parent)


def test_components_of_nodes_between_roots(spark):
    rng = random.Random(6)
    path = rng.sample(range(30), 12)
    graphs = [[(3, 1), (3, 2)], [(1, 4), (4, 3), (3, 5), (5, 2), (10, 11), (11, 12)], list(zip(path, path[1:]))]
    graphs += [[(rng.randrange(14), rng.randrange(14)) for _ in range(rng.randint(4, 12))] for _ in range(8)]
    for links in graphs:
        got = graph.components(spark.createDataFrame(links, "a long, b long"))
        assert sorted((r["node"], r["root"]) for r in got.collect()) == union_find(links)


def test_components_of_few_links_take_no_rounds(spark, monkeypatch):
    """A path of many nodes in few jobs, however many rounds it would take; by rounds the same."""
    path = random.Random(7).sample(range(-3000, 3000), 2000)
    links = list(zip(path[:1500], path[1:1500])) + list(zip(path[1500:], path[1501:])) + [(path[0], path[1]), (5000, 5000)]
    df = spark.createDataFrame(links, "a long, b long").repartition(8)
    spark.sparkContext.setJobGroup("few-links", "")
    try:
        got = sorted((r["node"], r["root"]) for r in graph.components(df).collect())
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == union_find(links)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few-links")) < 10  # rounds take more
    monkeypatch.setattr(graph, "TASK_LINKS", 100)
    assert sorted((r["node"], r["root"]) for r in graph.components(df).collect()) == got
    assert graph.components(df.limit(0)).count() == 0


@pytest.mark.parametrize("empty", [jaccard_join.jaccard_join, substring_dedup.substring_dedup, token_counts.token_counts, bpe_codec.round_trip_digests])
def test_empty_tables(docs, empty):
    assert empty(docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql_twin(spark, name):
    assert same(spark, queries.queries()[name], queries.oracle_sql()[name], SMALL) > 0
