"""Hard negatives, MinHash near-dedup and periodic runs against plain versions, on odd and on skewed tables."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from marketloom.llm import hard_negatives, jaccard_join, minhash, periodic_runs, queries
from test_operators import ODD, near_copies, plain_components


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, ODD[3]), (None, ODD[3]), (None, None), (50, None), (51, ODD[3] + " again"), (60, "a b " * 9 + "c"), (61, "la la la la la la la")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("key", "keys", "cls", "salt", "root", "start", "length", "n", "kept", "component_id", "label", "grp", "part"):
        df = df.withColumn(name, F.lit("clash"))
    return df


# MinHash


@pytest.mark.parametrize("percent,bands,rows", [(85, 40, 6), (50, 60, 3)])
def test_minhash_against_all_pairs(spark, docs, monkeypatch, percent, bands, rows):
    for blocks, df in ((512, docs), (3, spark.createDataFrame(near_copies(), "doc_id long, text string"))):
        monkeypatch.setattr(jaccard_join, "BLOCK_CLASSES", blocks)
        plain = plain_components([(r["doc_id"], r["text"]) for r in df.collect()], percent)
        got = minhash.minhash_dedup(df, percent=percent, bands=bands, rows=rows).collect()
        assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == plain
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_small_sets_and_one_large_group(spark):
    """Sets of some ten n-grams, of which most bins are filled from others, and hundreds of near copies of one text."""
    rng = random.Random(4)
    rows = []
    for g in range(150):
        base = [f"g{g}w{i}" for i in range(rng.randint(11, 16))]
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(base + ["more"]))]
    base = [f"c{i}" for i in range(200)]
    rows += [(len(rows) + i, " ".join(base[:190] + [f"x{i}"] + base[191:])) for i in range(300)]
    rng.shuffle(rows)
    got = minhash.minhash_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == plain_components(rows, 85)
    assert sum(r["kept"] for r in got) < len(rows) // 2


def test_signatures_agree_as_often_as_sets_do():
    sketch, rng = minhash.Sketch(), np.random.default_rng(1)
    for size, both in ((8, 7), (40, 30), (5000, 4000)):
        agree = []
        for _ in range(60):
            pool = rng.integers(0, 1 << 63, 2 * size - both, np.uint64) * np.uint64(2)
            a, b = np.unique(pool[:size]), np.unique(pool[size - both :])
            agree.append((sketch.signature(a) == sketch.signature(b)).mean())
        assert abs(np.mean(agree) - both / (2 * size - both)) < 0.05
    assert len(set(sketch.signature(np.array([7 << 40], np.uint64)).tolist())) == 1
    assert len(set(sketch.keys(np.array([7 << 40], np.uint64)).tolist())) == sketch.bands  # a band's keys are its own


def test_edges_of_a_bucket_are_a_star(spark):
    posted = spark.createDataFrame([(1, c) for c in range(50)] + [(2, 7), (2, 7), (3, 9), (3, 8)], "key long, cls long")
    edges = {tuple(r) for r in minhash.star_edges(posted).collect()}
    assert edges == {(c, 0) for c in range(1, 50)} | {(9, 8)}


# Periodic runs


def plain_runs(words, least=6, times=4):
    found = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            s = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i + q - s >= max(least, times * q) and i > s:
                found.setdefault((s, i + q - s), q)
            i += i == s
    return sorted((s, length, q) for (s, length), q in found.items())


def test_runs_against_all_periods():
    rng = random.Random(8)
    for _ in range(4000):
        n = rng.randint(0, 70)
        words = [rng.choice("abcde"[: rng.choice([1, 2, 3, 5])]) for _ in range(n)]
        if n > 3 and rng.random() < 0.7:
            a = rng.randrange(n)
            p = 1 + (n - a) // rng.randint(2, 9)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            if rng.random() < 0.5:
                words[rng.randrange(n)] = "z"
        assert periodic_runs.runs(words) == plain_runs(words)
        assert periodic_runs.runs(words, 2, 2) == plain_runs(words, 2, 2)


def test_runs_are_linear_in_repetitive_texts():
    import time

    fibonacci = ["a"], ["a", "b"]
    while len(fibonacci[1]) < 200_000:
        fibonacci = fibonacci[1], fibonacci[1] + fibonacci[0]
    began = time.perf_counter()
    assert periodic_runs.runs(["a"] * 200_000) == [(0, 200_000, 1)]
    assert periodic_runs.runs(fibonacci[1]) == []
    assert periodic_runs.runs([f"w{i % 777}" for i in range(200_000)]) == [(0, 200_000, 777)]
    assert len(periodic_runs.runs(["a" * (1 + i % 2) for i in range(100_000)] * 2)) == 1
    assert time.perf_counter() - began < 30


def plain_periodic(doc_id, text):
    words = [w for w in (text or "").translate({c: " " for c in range(9, 14)}).split(" ") if w]
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    top = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    shown = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    return (doc_id, len(found), *shown, digest("".join("%d,%d,%d\n" % r for r in found)), digest(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_periodic_runs_of_a_table(spark, docs):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["a", "b", "été\tc", "d\n\n"]) for _ in range(rng.randint(0, 200)))) for i in range(300)]
    for df in (docs, spark.createDataFrame(rows, "doc_id long, text string")):
        got = periodic_runs.periodic_runs(df, prepare=periodic_runs.periodic).collect()
        assert sorted(map(str, map(tuple, got))) == sorted(str(plain_periodic(r["doc_id"], r["text"])) for r in df.select("doc_id", "text").collect())


def test_the_query_of_periodic_runs(spark):
    sf = "/root/testdata/sf0.001"
    small = spark.read.parquet(f"{sf}/documents.parquet").filter("n_chars < 4000").collect()
    got = {r["doc_id"]: tuple(r) for r in queries.op13_periodic_runs(spark, sf).collect()}
    assert len(got) == 200 and all(got[r["doc_id"]] == plain_periodic(r["doc_id"], r["text"]) for r in small)


# Hard negatives


def plain_negatives(rows, is_anchor, n_positives=5, n_negatives=10):
    """Rows (id, label, vector) with one row an id."""
    fine = [(i, lab, [int(np.floor(256.0 * float(np.float64(x)))) for x in v]) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a in (r for r in fine if is_anchor(r[0])):
        scored = sorted((-dot(a[2], r[2]), r[0], r[1]) for r in fine if r[0] != a[0])
        for s, positive, _ in [x for x in scored if x[2] == a[1]][:n_positives]:
            negatives = [(-t, i) for t, i, lab in scored if lab != a[1] and 30 * -s <= 100 * -t <= 90 * -s][:n_negatives]
            out += [(a[0], positive, rank, i, -s, t) for rank, (t, i) in enumerate(negatives, 1)]
    return sorted(out)


VECTORS = StructType([StructField("vec_id", LongType()), StructField("label", IntegerType()), StructField("embedding", ArrayType(DoubleType())), StructField("grp", StringType()), StructField("slice", StringType())])


def clustered(n, seed, hot=0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, 12))
    vectors = centres[rng.integers(0, 6, n)] + 0.4 * rng.standard_normal((n, 12))
    vectors *= rng.lognormal(0, 0.7, n)[:, None]
    vectors[:hot] = centres[0]
    return [(int(i), int(rng.integers(0, 3)), v.tolist(), "x", "y") for i, v in zip(rng.permutation(n), vectors)]


@pytest.mark.parametrize("sizes", [{}, {"sample": 60, "group": 3, "slice_rows": 40}, {"sample": 3, "pivots": 2, "group": 1, "slice_rows": 1000}])
def test_hard_negatives_against_brute_force(spark, sizes):
    rows = clustered(500, 1, hot=120)
    got = hard_negatives.hard_negatives(spark.createDataFrame(rows, VECTORS).repartition(4), F.col("vec_id") % 20 == 0, F.col("label"), **sizes)
    assert sorted(map(tuple, got.collect())) == plain_negatives([r[:3] for r in rows], lambda i: i % 20 == 0)


def test_hard_negatives_of_odd_rows(spark):
    v = [0.5, -0.25, 1.0]
    rows = [(100, 1, v, "", ""), (200, 1, v, "", ""), (1, 1, [0.0, 0.0, 0.0], "", ""), (2, 2, v[:2], "", ""), (3, 2, [0.4, 0.0, 0.3], "", ""), (4, 2, None, "", ""), (5, None, v, "", ""), (6, 2, [float("nan"), 0.0, 0.0], "", ""), (7, 2, [float("inf"), 0.0, 0.0], "", ""), (8, 2, [None, 1.0, 1.0], "", ""), (None, 2, v, "", ""), (300, 3, [0.0, 0.0, 0.0], "", ""), (9, 3, [0.0, 0.0, 0.0], "", ""), (10, 2, [], "", ""), (11, 2, [0.4, 0.0, 0.3], "", ""), (11, 2, [0.4, 0.0, 0.3], "", ""), (12, 2, [-3.0, -3.0, -3.0], "", ""), (400, 4, [-1.0, -1.0, -1.0], "", ""), (13, 4, [1.0, 1.0, 1.0], "", "")]
    df = spark.createDataFrame(rows, VECTORS)
    got = hard_negatives.hard_negatives(df, F.col("vec_id") % 100 == 0, F.col("label")).collect()
    padded = [(i, lab, v if v is None else v + [0.0] * (3 - len(v))) for i, lab, v, *_ in rows if i != 11] + [(11, 2, [0.4, 0.0, 0.3])]
    assert sorted(map(tuple, got)) == plain_negatives(padded, lambda i: i % 100 == 0) and any(r["positive_score"] == 0 for r in got)
    for empty in (df.limit(0), df.filter("vec_id < 100"), df.filter("embedding is null")):
        assert hard_negatives.hard_negatives(empty, F.col("vec_id") % 100 == 0, F.col("label")).count() == 0
    with pytest.raises(ValueError, match="2\\^53"):
        hard_negatives.hard_negatives(df.withColumn("embedding", F.transform("embedding", lambda x: x * 1e12)), F.col("vec_id") % 100 == 0, F.col("label"))


def test_bounds_spare_rows_far_from_all_anchors_of_a_group(spark):
    """In clusters far apart a group is sent hardly more than its own clusters' rows, a hot cell's in several slices."""
    rng = np.random.default_rng(3)
    directions = np.eye(16)
    rows = [(i, 0, (directions[i % 16] + 0.02 * rng.standard_normal(16)).tolist(), "", "") for i in range(3200)]
    usable = hard_negatives.usable(spark.createDataFrame(rows, VECTORS), F.col("label"))
    join = hard_negatives.Join(usable, F.col("vec_id") % 25 == 0, sample=800, pivots=64, group=8, slice_rows=100)
    joined = join.positives(5)
    assert joined.count() == 128 * 5
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan
    anchors = usable.filter(F.col("vec_id") % 25 == 0)
    x = np.array([r["vec"] for r in anchors.orderBy("vec_id").collect()])
    everyone = np.array([r["vec"] for r in usable.collect()])
    least = hard_negatives.kth_best(x @ join.sphere.vectors.T, np.arange(0, 3200, 25)[:, None] != join.sphere.ids[None, :], 5)
    cell, away = join.sphere.cells(x)
    bound = np.full(len(join.sphere.pivots), -np.inf)
    np.maximum.at(bound, cell, away + join.sphere.reach(x, least))
    near = hard_negatives.angles(join.sphere.members(everyone) @ join.sphere.pivots.T) <= bound
    assert near.sum(axis=0)[np.isfinite(bound)].max() < 500  # of 3,200 rows; a cluster has 200


@pytest.mark.parametrize("operator", [minhash.minhash_dedup, periodic_runs.periodic_runs])
def test_new_operators_on_empty_tables(docs, operator):
    assert operator(docs.limit(0)).count() == 0


def test_near_copies_are_sent_to_pivots_once_however_many_they_are(spark, monkeypatch):
    from marketloom.llm import jaccard_join

    sent, real = [], jaccard_join.Join.block_links
    monkeypatch.setattr(jaccard_join, "BLOCK_CLASSES", 20)
    monkeypatch.setattr(jaccard_join.Join, "block_links", lambda self, members, routed: sent.append(routed.count()) or real(self, members, routed))
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(base[: i % 197] + [f"x{i}"] + base[i % 197 + 1 :])) for i in range(400)]
    rows += [(1000 + i, " ".join(base[:170] + [f"y{j}" for j in range(30)] + [f"z{i}"])) for i in range(3)]
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: jaccard_join.shingle_sets([t])[0] for i, t in rows}
    ids = sorted(sets)
    left, right = jaccard_join.linked([sets[i] for i in ids], jaccard_join.PERCENT)
    assert got == dict(zip(ids, np.array(ids)[jaccard_join.roots(len(ids), left, right)].tolist()))
    assert sum(sent) < 3 * len(rows)  # one by one in pairs of blocks: 20 times as many
