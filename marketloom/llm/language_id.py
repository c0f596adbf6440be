"""Language identification by error-correcting output codes.

Each language has a codeword; for each bit a binary classifier over byte trigrams (naive Bayes log odds between the
languages with that bit and those without, every language weighted alike) gives a margin.  Decoding adds the
logistic losses of the margins against each codeword, each bit weighted by how often it is right on that language's
training texts; the codeword with the least loss wins, and texts whose second best is within ``AMBIGUOUS`` are flagged.

Trigram counts and bit weights come from all training texts; only their sums reach the driver, GRAMS numbers for each
language (names of languages are taken as few; a table of names is not kept apart).  Trigrams don't reach from one
text into the next, so the model doesn't depend on partitions.

Texts that are null or have no letters are ``und`` with score 0; without training languages all texts are.  Texts are
read whole.  Of equal losses the language first in the alphabet wins.  Rows with a null text or lang are not learned
from; repeated rows count as often as they come.  Extra columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, plain_ids, slices, spread, texts

GRAMS = 1 << 15
SHARPNESS, AMBIGUOUS, UNKNOWN = 20.0, 0.1, "und"
#: Bytes of text that are looked at together.
STRETCH = 2_000_000
LETTER = regex.compile(r"\p{L}")
PREDICTED = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_())])
COUNTS = pa.schema([("lang", pa.string()), ("gram", pa.int32()), ("n", pa.int64())])
RIGHT = pa.schema([("lang", pa.string()), ("bit", pa.int32()), ("n_right", pa.int64()), ("n", pa.int64())])

FOLD = np.arange(256, dtype=np.uint8)
FOLD[ord("A") : ord("Z") + 1] += 32
FOLD[[b for b in range(128) if not chr(b).isalpha()]] = 32


def trigrams(rows: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Trigram numbers of all rows, one after the other, and where each row starts.  A row has one at least."""
    raw = [b" " + t.encode("utf-8", "surrogatepass") + b"  " for t in rows]
    data = FOLD[np.frombuffer(b"".join(raw), np.uint8)].astype(np.uint32)
    ids = (data[:-2] * np.uint32(0x9E3779B1) + data[1:-1] * np.uint32(0x85EBCA6B) + data[2:] * np.uint32(0xC2B2AE35)) >> np.uint32(17)
    return ids.astype(np.int32), np.concatenate([[0], np.cumsum([len(r) for r in raw])[:-1]])


def spanning(starts: np.ndarray) -> np.ndarray:
    """Places of the trigrams that reach from one row into the next."""
    return np.concatenate([starts[1:] - 1, starts[1:] - 2])


def stretches(rows: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about STRETCH bytes."""
    start, size = 0, 0
    for i, t in enumerate(rows):
        if size and size + len(t) > STRETCH:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(rows):
        yield start, len(rows)


def codewords(n: int) -> np.ndarray:
    """A row of +1 and -1 for each language: all distinct splits up to 7 languages, a fixed random code beyond."""
    if n <= 7:
        splits = [s for s in product((1, -1), repeat=n) if s[0] == 1 and -1 in s]
        return np.array(splits, np.float64).reshape(-1, n).T
    rng, bits = np.random.default_rng(5), int(np.ceil(10 * np.log2(n)))
    while True:
        out = rng.choice([-1.0, 1.0], (n, bits))
        if len({tuple(r) for r in out}) == n and (np.abs(out.sum(axis=0)) < n).all():
            return out


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages by bits
    weights: np.ndarray  # bits by trigrams
    trust: np.ndarray  # languages by bits

    def margins(self, rows: list[str]) -> np.ndarray:
        """Mean log odds of each row for each bit."""
        ids, starts = trigrams(rows)
        ends = np.append(starts[1:], len(ids) + 2)
        n = np.maximum(ends - starts - 2, 1)
        out = np.empty((len(rows), len(self.weights)))
        # Trigrams that span two rows (the last two of each) count for none.
        spans = spanning(starts)
        for j, w in enumerate(self.weights):
            given = w[ids]
            given[spans] = 0
            out[:, j] = np.add.reduceat(given, starts, dtype=np.float64) / n
        return out

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """Weighted loss of each row (first axis) for each language."""
        reach = margins[:, None, :] * self.code[None] * SHARPNESS
        return (np.logaddexp(0, -reach) * self.trust[None]).sum(axis=2)

    def predict(self, rows: list[str]) -> list[tuple[str, float, bool]]:
        readable = [bool(LETTER.search(t)) for t in rows]
        if not self.languages or not any(readable):
            return [(UNKNOWN, 0.0, True)] * len(rows)
        loss = self.losses(self.margins(rows))
        share = np.exp(loss.min(axis=1, keepdims=True) - loss)
        share /= share.sum(axis=1, keepdims=True)
        best = loss.argmin(axis=1)
        ordered = np.sort(share, axis=1)
        close = ordered[:, -1] - ordered[:, -2] < AMBIGUOUS if share.shape[1] > 1 else np.zeros(len(rows), bool)
        return [(self.languages[b], float(share[i, b]), bool(close[i])) if readable[i] else (UNKNOWN, 0.0, True) for i, b in enumerate(best)]


def by_language(b: pa.RecordBatch) -> Iterator[tuple[str, list[str]]]:
    langs = np.array(b.column("lang").to_pylist(), object)
    rows = np.array(texts(b.column("text")), object)
    for lang in sorted(set(langs)):
        own = rows[langs == lang].tolist()
        for s, e in stretches(own):
            yield lang, own[s:e]


def fit(training: DataFrame) -> Model:
    """Learn from all rows of ``training`` (text, lang) with a text and a language."""
    rows = training.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter("text is not null and lang is not null")
    rows = spread(rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for b in slices(batches):
            for lang, own in by_language(b):
                seen.setdefault(lang, np.zeros(GRAMS, np.int64))
                ids, starts = trigrams(own)
                seen[lang] += np.bincount(np.delete(ids, spanning(starts)), minlength=GRAMS)
        for lang, n in seen.items():
            at = np.flatnonzero(n)
            yield batch(COUNTS, [lang] * len(at), pa.array(at, pa.int32()), pa.array(n[at]))

    counted = rows.mapInArrow(count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counted["lang"].unique())
    code = codewords(len(languages)) if languages else np.zeros((0, 0))
    odds = np.full((len(languages), GRAMS), 0.5)
    for k, lang in enumerate(languages):
        own = counted[counted["lang"] == lang]
        odds[k, own["gram"].to_numpy()] += own["n"].to_numpy()
    odds /= odds.sum(axis=1, keepdims=True)
    weights = np.array([np.log(odds[bits > 0].mean(axis=0) / odds[bits < 0].mean(axis=0)) for bits in code.T], np.float32).reshape(-1, GRAMS)
    model = Model(languages, code, weights, np.ones(code.shape))
    if code.size:
        model.trust = measured(rows, model)
    return model


def measured(rows: DataFrame, model: Model) -> np.ndarray:
    """How often each bit is right on each language's training texts, scaled to a mean of 1."""
    place = {lang: k for k, lang in enumerate(model.languages)}
    held = rows.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right, n = np.zeros(held.value.code.shape, np.int64), np.zeros(len(place), np.int64)
        for b in slices(batches):
            for lang, own in by_language(b):
                k = place[lang]
                right[k] += (held.value.margins(own) * held.value.code[k] > 0).sum(axis=0)
                n[k] += len(own)
        for lang, k in place.items():
            bits = right.shape[1]
            yield batch(RIGHT, [lang] * bits, pa.array(range(bits), pa.int32()), pa.array(right[k]), [int(n[k])] * bits)

    out = np.zeros(model.code.shape)
    for r in rows.mapInArrow(judge, "lang string, bit int, n_right long, n long").groupBy("lang", "bit").agg(F.sum("n_right").alias("n_right"), F.sum("n").alias("n")).collect():
        out[place[r["lang"]], r["bit"]] = (r["n_right"] + 1) / (r["n"] + 2)
    return out / out.mean(axis=1, keepdims=True)


def identify(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and ambiguous of every row of ``documents``."""
    held = documents.sparkSession.sparkContext.broadcast(model)  # bounded by the number of languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = texts(b.column("text"))
            out = [p for s, e in stretches(rows) for p in held.value.predict(rows[s:e])]
            yield batch(PREDICTED, b.column("doc_id"), *([p[k] for p in out] for k in range(3)))

    return plain_ids(documents, "doc_id").mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")
