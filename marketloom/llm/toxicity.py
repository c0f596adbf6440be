"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, distance-weighted votes.

A text's terms are the stems of its words: their first four letters, lower-cased.  In scripts that don't part words
(and others without case) each letter begins a term of two letters.  A term weighs its count times a power of
ln(documents / documents that hold it).  Document frequencies are counted over all documents.

The examples are a bounded sample of the labelled rows (``n_examples``, chosen by a hash of id and text); all of their
terms are the vocabulary, and every one of them is indexed, whatever its label and terms.  Lists of rare terms are
postings; those of terms that many examples hold are rows of a matrix, with the largest weight of each block of
examples.  For a query the rare lists are added up; with the bounds of the frequent ones that gives each block a
bound.  The best blocks are scored first, then all whose bound reaches the k-th best so far: the neighbours are exact.

k is the root of the number of examples.  Votes are weighted by cosine.  Their share is calibrated by a rising curve,
fitted to the examples' own votes when each is left out, so the score estimates the probability of label 1; the
nearest examples are the evidence.  Shares, hence scores, don't depend on the length of a query's vector.  It counts
in the reported cosines: terms that no example holds are in it, with document frequencies from ``OTHER`` hashed slots.

Null and empty texts, and texts that share no term with any example, get the rate of label 1 among such examples (the
rate of all where there are none).  Null labels are not learned from; of several labels of a document the larger counts.
Rows of one id with different texts are examples of their own; equal ones are one.  If there are no labelled rows, or
all have one label, every score is their rate of label 1 (0 if none).  Cosines that agree to six digits are ties, which
fall to the example first in the index.  Texts of any length are read whole.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, plain_ids, slices, spread, texts, tidy

N_EXAMPLES, STEM, IDF_POWER = 4_000, 4, 1.5
#: Examples of a block, share of the examples from which on a term is frequent, hashed slots of terms without example.
BLOCK, FREQUENT, OTHER = 64, 0.04, 1 << 16
#: Characters and rows looked at together.
STRETCH, TOGETHER = 500_000, 256
EVIDENCE = 5
SCORED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("evidence", pa.list_(pa.int64())), ("cosines", pa.list_(pa.float64()))])
VECTORS = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("text_hash", pa.int64()), ("terms", pa.binary()), ("counts", pa.binary())])
COUNTS = pa.schema([("term", pa.int32()), ("n", pa.int64())])
SPREAD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


@functools.cache
def letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point, whether it is a letter or mark, and whether it is a letter without case."""
    kinds = [unicodedata.category(chr(c)) for c in range(0x110000)]
    return np.array([k[0] in "LM" for k in kinds]), np.array([k == "Lo" for k in kinds])


def parts_of(rows: list[str]) -> Iterator[tuple[int, str]]:
    """(row, text) of at most about STRETCH characters; longer texts are parted between words."""
    for i, text in enumerate(rows):
        at = 0
        while len(text) - at > STRETCH:
            end = at + STRETCH
            while end < len(text) and (text[end].isalpha() or unicodedata.category(text[end])[0] == "M"):
                end += 1
            yield i, text[at:end]
            at = end
        yield i, text[at:]


def stems(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Number of the part and hash of the term, for each term of each part."""
    is_letter, bare = letters()
    lowered = [t.lower() for t in parts]
    codes = np.frombuffer(("\n" + "\n".join(lowered) + "\n" * (STEM + 1)).encode("utf-32-le", "surrogatepass"), np.uint32)
    seen, single = is_letter[codes], bare[codes]
    starts = np.flatnonzero(seen[1:] & (~seen[:-1] | single[1:])) + 1
    letter = codes[starts].astype(np.uint64)
    hashes, more = letter * SPREAD[0], np.ones(len(starts), bool)
    for j in range(1, STEM):
        more &= seen[starts + j] & (~single[starts] if j > 1 else True)
        letter = np.where(more, codes[starts + j], 0).astype(np.uint64)
        hashes = (hashes ^ (letter * SPREAD[1])) * SPREAD[2]
        hashes ^= hashes >> np.uint64(29)
    return np.searchsorted(np.cumsum([len(t) + 1 for t in lowered]), starts - 1, side="right"), hashes


def counted(rows: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end, row, term, count) of groups of rows; the terms of each row ascend."""
    begin, size = 0, 0
    for end in range(1, len(rows) + 1):
        size += len(rows[end - 1])
        if end < len(rows) and size < STRETCH and end - begin < TOGETHER:
            continue
        row, term, n = [], [], []
        held, chars = [], 0
        for part in parts_of(rows[begin:end]):
            held.append(part)
            chars += len(part[1])
            if chars >= STRETCH:
                collect(held, row, term, n)
                held, chars = [], 0
        collect(held, row, term, n)
        yield (begin, end, *summed(*map(np.concatenate, (row, term, n))))
        begin, size = end, 0


def collect(held: list[tuple[int, str]], row: list, term: list, n: list) -> None:
    part, hashes = stems([t for _, t in held])
    got = summed(np.array([i for i, _ in held], np.int64)[part], hashes, np.ones(len(part), np.int64))
    for out, x in zip((row, term, n), got):
        out.append(x)


def summed(row: np.ndarray, term: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((term, row))
    row, term, n = row[order], term[order], n[order]
    new = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (term[1:] != term[:-1]))[: len(row)])
    return row[new], term[new], np.add.reduceat(n, new) if len(new) else n


@dataclass
class Model:
    vocabulary: np.ndarray  # hashes of the examples' terms, ascending
    idf: np.ndarray  # of the vocabulary, then of the slots of other terms
    base: float  # rate of label 1 among all examples
    bare: float  # among those without a term
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    labels: np.ndarray = field(default_factory=lambda: np.zeros(0))
    ends: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # of each example's entries in the next two
    terms: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    curve: tuple[np.ndarray, np.ndarray] = field(default_factory=lambda: (np.array([0.0, 1.0]), np.array([0.0, 1.0])))

    @property
    def k(self) -> int:
        return max(int(np.sqrt(len(self.ids))), 1)

    def numbered(self, terms: np.ndarray) -> np.ndarray:
        """Place of each term in ``idf``."""
        other = len(self.vocabulary) + (terms % np.uint64(OTHER)).astype(np.int64)
        if not len(self.vocabulary):
            return other
        at = np.minimum(np.searchsorted(self.vocabulary, terms), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == terms, at, other)

    def weighed(self, row: np.ndarray, place: np.ndarray, n: np.ndarray, n_rows: int) -> np.ndarray:
        """Weights of length 1 for each row."""
        weight = n * self.idf[place]
        length = np.sqrt(np.bincount(row, weight**2, minlength=n_rows))
        return weight / np.maximum(length, np.finfo(float).tiny)[row]

    def share(self, near: np.ndarray, cosines: np.ndarray) -> np.ndarray:
        """Share of the votes that are for label 1."""
        votes = np.where(cosines > 0, cosines, 0)
        return (votes * self.labels[near]).sum(axis=1) / np.maximum(votes.sum(axis=1), np.finfo(float).tiny)

    def scores(self, near: np.ndarray, cosines: np.ndarray) -> np.ndarray:
        return np.where(cosines[:, 0] > 0, np.interp(self.share(near, cosines), *self.curve), self.bare)


class Index:
    """The block-max inverted index of a model's examples."""

    def __init__(self, model: Model):
        self.model, n = model, len(model.ids)
        self.blocks = -(-n // BLOCK)
        self.size = self.blocks * BLOCK
        example = np.repeat(np.arange(n), np.diff(np.append(0, model.ends)))
        order = np.argsort(model.terms, kind="stable")
        self.at, self.given = example[order], model.weights[order]
        self.start = np.searchsorted(model.terms[order], np.arange(len(model.idf) + 1))
        held = np.diff(self.start)
        frequent = np.flatnonzero(held > FREQUENT * n)
        self.column = np.full(len(model.idf), -1)
        self.column[frequent] = np.arange(len(frequent))
        inside = np.flatnonzero(self.column[model.terms] >= 0)
        self.matrix = np.zeros((len(frequent), self.size), np.float32)
        self.matrix[self.column[model.terms[inside]], example[inside]] = model.weights[inside]
        self.most = self.matrix.reshape(len(frequent), self.blocks, BLOCK).max(axis=2) if self.blocks else np.zeros((len(frequent), 0), np.float32)

    def nearest(self, row: np.ndarray, place: np.ndarray, weight: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and cosines of the k nearest examples of n queries, nearest first; cosine 0 stands for none."""
        column = self.column[place]
        dense, rare = np.flatnonzero(column >= 0), np.flatnonzero(column < 0)
        asked = np.zeros((n, len(self.matrix)), np.float32)
        asked[row[dense], column[dense]] = weight[dense]
        held = self.start[place[rare] + 1] - self.start[place[rare]]
        entry = np.repeat(self.start[place[rare]] - (np.cumsum(held) - held), held) + np.arange(held.sum())
        flat = np.repeat(row[rare] * self.size, held) + self.at[entry]
        score = np.bincount(flat, np.repeat(weight[rare], held) * self.given[entry], minlength=n * self.size).astype(np.float32).reshape(n, self.blocks, BLOCK)
        bound = score.max(axis=2) + asked @ self.most + np.float32(1e-5)
        scored = np.zeros((n, self.blocks), bool)

        def visit(wanted: np.ndarray) -> None:
            for b in np.flatnonzero(wanted.any(axis=0)).tolist():
                q = np.flatnonzero(wanted[:, b])
                score[q, b] += asked[q] @ self.matrix[:, b * BLOCK : (b + 1) * BLOCK]
            scored[wanted] = True

        best = np.argsort(-bound, axis=1, kind="stable")[:, : -(-k // BLOCK) + 1]
        first = np.zeros((n, self.blocks), bool)
        np.put_along_axis(first, best, True, axis=1)
        visit(first)
        found = np.take_along_axis(score, best[:, :, None], axis=1).reshape(n, -1)
        least = np.partition(found, -k, axis=1)[:, -k] if found.shape[1] >= k else np.zeros(n, np.float32)
        visit((bound >= least[:, None]) & (bound > 1e-5) & ~scored)
        score[~scored] = 0
        # Cosines to six digits, then the place: all keys differ.
        keys = np.rint(score.reshape(n, -1) * 1e6).astype(np.int64) * self.size + (self.size - 1 - np.arange(self.size))
        k = min(k, self.size)
        near = np.argpartition(keys, self.size - k, axis=1)[:, self.size - k :]
        order = np.argsort(-np.take_along_axis(keys, near, axis=1), axis=1)
        near = np.take_along_axis(near, order, axis=1)
        cosines = np.take_along_axis(score.reshape(n, -1), near, axis=1).astype(np.float64)
        return np.minimum(near, len(self.model.ids) - 1), np.where(np.rint(cosines * 1e6) > 0, cosines, 0.0)

    def read(self, rows: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Scores, and numbers and cosines of the nearest examples, of groups of texts."""
        model = self.model
        for begin, end, row, term, n in counted(rows):
            if not len(model.ids):
                yield np.full(end - begin, model.bare), np.zeros((end - begin, 0), np.int64), np.zeros((end - begin, 0))
                continue
            place = model.numbered(term)
            near, cosines = self.nearest(row, place, model.weighed(row, place, n, end - begin), end - begin, model.k)
            yield model.scores(near, cosines), near, cosines


def chosen_ids(labelled: DataFrame, n_examples: int) -> DataFrame:
    """(doc_id, toxic) of the sampled labelled rows: at most n_examples ids, the first by a hash."""
    known = labelled.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n_examples)


def vectors(documents: DataFrame, examples: DataFrame, n_examples: int) -> list:
    """doc_id, toxic, terms and counts of the different texts of the examples; n_examples rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 100):
            terms, counts = [], []
            for begin, end, row, term, n in counted(texts(b.column("text"))):
                cuts = np.searchsorted(row, np.arange(end - begin + 1))
                terms += [term[s:e].tobytes() for s, e in zip(cuts, cuts[1:])]
                counts += [n[s:e].tobytes() for s, e in zip(cuts, cuts[1:])]
            yield batch(VECTORS, b.column("doc_id"), b.column("toxic"), b.column("text_hash"), terms, counts)

    rows = plain_ids(documents, "doc_id").join(F.broadcast(examples), "doc_id").select("doc_id", "toxic", F.xxhash64("text").alias("text_hash"), "text")
    found = rows.mapInArrow(tidy(run), "doc_id long, toxic int, text_hash long, terms binary, counts binary").dropDuplicates(["doc_id", "text_hash"])
    return found.orderBy(F.xxhash64("doc_id", "text_hash"), "doc_id", "text_hash").limit(n_examples).collect()


def document_frequencies(documents: DataFrame, model: Model) -> tuple[np.ndarray, int]:
    """Documents that hold each term, over all documents, and the number of documents."""
    held = documents.sparkSession.sparkContext.broadcast(model.vocabulary)  # bounded by n_examples
    size = len(model.idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, places = np.zeros(size + 1, np.int64), Model(held.value, np.zeros(0), 0.0, 0.0)
        for b in slices(batches):
            df[size] += b.num_rows
            for _, _, row, term, _ in counted(texts(b.column("text"))):
                place = places.numbered(term)
                shared = place >= len(places.vocabulary)  # a slot counts once a text
                df[:size] += np.bincount(place[~shared], minlength=size)
                df[:size] += np.bincount(np.unique(row[shared] * size + place[shared]) % size, minlength=size)
        at = np.flatnonzero(df)
        yield batch(COUNTS, pa.array(at, pa.int32()), pa.array(df[at]))

    found = spread(documents.select(F.col("text").cast("string").alias("text"))).mapInArrow(tidy(run), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size + 1, np.int64)
    out[found.column("term").to_numpy()] = found.column("n").to_numpy()
    return out[:-1], int(out[-1])


def fit(documents: DataFrame, labelled: DataFrame, n_examples: int = N_EXAMPLES) -> Model:
    """Learn from ``labelled`` (doc_id, toxic), with document frequencies over all of ``documents``."""
    spark = documents.sparkSession
    known = chosen_ids(labelled, n_examples).collect()  # bounded by n_examples
    examples = spark.createDataFrame([(r["doc_id"], r["toxic"]) for r in known], "doc_id long, toxic int")
    rows = vectors(documents, examples, n_examples)
    labels = np.array([float(r["toxic"] > 0) for r in rows])
    rate = float(labels.mean()) if len(rows) else 0.0
    if rate in (0.0, 1.0):
        return Model(np.zeros(0, np.uint64), np.zeros(OTHER), rate, rate)
    size = np.array([len(r["terms"]) // 8 for r in rows])
    term = np.frombuffer(b"".join(r["terms"] for r in rows), np.uint64)
    n = np.frombuffer(b"".join(r["counts"] for r in rows), np.int64)
    vocabulary = np.unique(term)
    model = Model(vocabulary, np.zeros(len(vocabulary) + OTHER), rate, rate)
    df, n_docs = document_frequencies(documents, model)
    model.idf = np.log(max(n_docs, 1) / np.maximum(df, 1)) ** IDF_POWER
    model = indexed(model, np.array([r["doc_id"] for r in rows], np.int64), labels, size, term, n)
    return calibrated(spark, model)


def indexed(model: Model, ids: np.ndarray, labels: np.ndarray, size: np.ndarray, term: np.ndarray, n: np.ndarray) -> Model:
    """The model with its examples, each of ``size`` terms.  Examples alike in their heaviest term stand together: tighter bounds."""
    bare = labels[size == 0]
    row = np.repeat(np.arange(len(ids)), size)
    place = model.numbered(term)
    weight = model.weighed(row, place, n, len(ids))
    heaviest = np.full(len(ids), -1)
    order = np.lexsort((weight, row))
    heaviest[row[order]] = place[order]  # the last one stays
    rank = np.lexsort((ids, labels, heaviest))
    entries = np.argsort(np.argsort(rank)[row], kind="stable")
    return Model(model.vocabulary, model.idf, model.base, float(bare.mean()) if len(bare) else model.base, ids[rank], labels[rank], np.cumsum(size[rank]), place[entries].astype(np.int32), weight[entries].astype(np.float32))


def calibrated(spark, model: Model) -> Model:
    """The model with the curve from shares of votes to rates of label 1, over the examples, each without itself."""
    held = spark.sparkContext.broadcast(model)  # bounded by n_examples
    votes = pa.schema([("example", pa.int32()), ("share", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        index, begins = Index(model), np.append(0, model.ends)
        for b in slices(batches, TOGETHER):
            own = b.column("id").to_numpy()
            size = begins[own + 1] - begins[own]
            entry = np.repeat(begins[own] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            near, cosines = index.nearest(np.repeat(np.arange(len(own)), size), model.terms[entry], model.weights[entry].astype(np.float64), len(own), model.k + 1)
            others = np.sort(np.argsort(near == own[:, None], axis=1, kind="stable")[:, : model.k], axis=1)  # itself, or the last one, goes
            near, cosines = np.take_along_axis(near, others, axis=1), np.take_along_axis(cosines, others, axis=1)
            fine = cosines[:, 0] > 0
            yield batch(votes, pa.array(own[fine], pa.int32()), pa.array(model.share(near, cosines)[fine]))

    found = spark.range(len(model.ids)).repartition(max(1, len(model.ids) // 500)).mapInArrow(tidy(run), "example int, share double").toArrow()
    order = np.argsort(found.column("example").to_numpy())
    x, y = found.column("share").to_numpy()[order], model.labels[found.column("example").to_numpy()[order]]
    if len(x):
        model.curve = isotonic(x, y, model.base)
    return model


def isotonic(x: np.ndarray, y: np.ndarray, base: float) -> tuple[np.ndarray, np.ndarray]:
    """Points of the rising curve nearest to y: means of x, and of y with one row of the base rate, of pooled neighbours."""
    pools: list[list[float]] = []  # rows, sum of x, sum of y
    for a, b in zip(*(v[np.argsort(x, kind="stable")].tolist() for v in (x, y))):
        pools.append([1.0, a, b])
        while len(pools) > 1 and pools[-1][2] * pools[-2][0] <= pools[-2][2] * pools[-1][0]:
            last = pools.pop()
            pools[-1] = [u + v for u, v in zip(pools[-1], last)]
    n, sums, hits = np.array(pools).reshape(-1, 3).T
    return sums / n, np.maximum.accumulate((hits + base) / (n + 1))


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1), evidence (ids of the nearest examples) and their cosines, of every row of ``documents``."""
    held = documents.sparkSession.sparkContext.broadcast(model)  # bounded by n_examples

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(held.value)
        for b in slices(batches):
            scores, evidence, cosines = [], [], []
            for value, near, cosine in index.read(texts(b.column("text"))):
                n = (cosine[:, :EVIDENCE] > 0).sum(axis=1).tolist()
                scores += value.tolist()
                evidence += [x[:m] for x, m in zip(index.model.ids[near[:, :EVIDENCE]].tolist(), n)]
                cosines += [x[:m] for x, m in zip(cosine[:, :EVIDENCE].tolist(), n)]
            yield batch(SCORED, b.column("doc_id"), scores, evidence, cosines)

    return plain_ids(documents, "doc_id").mapInArrow(tidy(run), "doc_id long, score double, evidence array<long>, cosines array<double>")


def without_toxic(documents: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``documents``, all columns as they are, whose score is under ``threshold``."""
    held = documents.sparkSession.sparkContext.broadcast(model)  # bounded by n_examples

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(held.value)
        for b in slices(batches):
            scores = [value for value, _, _ in index.read(texts(b.column("text")))]
            yield b.filter(pa.array(np.concatenate(scores) < threshold if scores else [], pa.bool_()))

    return spread(documents).mapInArrow(tidy(run), documents.schema)
