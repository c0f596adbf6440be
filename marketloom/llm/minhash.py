"""Near-duplicate documents by one-permutation MinHash with optimal densification, confirmed on whole sets.

A document's set holds the hashes of its distinct word n-grams; documents with equal sets are one class, so copies never
meet as pairs.

1.  One hash of each n-gram is its place in a permutation, cut into BANDS * ROWS bins; a bin's value is the least hash in
    it.  An empty bin takes the value of the first bin with one, in an order of all bins that is drawn for each bin once
    and for all (the densification of least variance: whatever the size of the sets, two of them agree in a bin with a
    chance of their similarity, bin by bin on its own).
2.  ROWS bins are a band, its values the key of a bucket.  Sets of similarity s share a bucket with a chance of
    1 - (1 - s^ROWS)^BANDS: all but 6e-9 of the pairs at 0.85.  Sets too small to link with any other have no buckets.
3.  A bucket's candidates are a star around its least class: as many edges as members.  Stars are joined to coarse
    components, so that two members of a bucket who fit each other, but not its centre, aren't parted.
4.  Links are confirmed on full sets, within coarse components, by blocks (see ``jaccard_join``); then components of the
    links, and of the documents.

A document with fewer than n words is one n-gram of its whole sequence.  Null, empty and blank texts have no n-grams and
are linked with nothing.  Repeated rows are copies.  A null id belongs to its class and is never a component's id, nor
kept if it has one.  Extra columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, cut, tidy
from .graph import components
from .jaccard_join import COUNTED, WORDS, Join, class_of, copied, salted, settled, sets_of
from .rolling import mix

PERCENT, BANDS, ROWS, SEED = 85, 40, 6, 61_507

SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("cls", pa.int64()), ("keys", pa.list_(pa.int64()))])


class Sketch:
    """Signatures and bucket keys of sets of 64-bit hashes."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS):
        self.bands, self.rows, self.bins = bands, rows, bands * rows
        rng = np.random.default_rng(SEED)
        #: rank[b, c]: when bin b, if empty, asks bin c.
        self.rank = rng.permuted(np.tile(np.arange(self.bins, dtype=np.uint16), (self.bins, 1)), axis=1)
        self.weight = rng.integers(1, 1 << 63, (bands, rows), np.uint64) * np.uint64(2) + np.uint64(1)

    def signature(self, grams: np.ndarray) -> np.ndarray:
        """The least hash of each bin of a sorted, not empty set; empty bins are filled from others."""
        at = ((grams >> np.uint64(32)) * np.uint64(self.bins)) >> np.uint64(32)  # ascending, as the hashes are
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        filled = at[first].astype(np.int64)
        out = np.zeros(self.bins, np.uint64)
        out[filled] = grams[first]
        if len(filled) < self.bins:
            empty = np.setdiff1d(np.arange(self.bins), filled, assume_unique=True)
            out[empty] = out[filled[self.rank[np.ix_(empty, filled)].argmin(axis=1)]]
        return out

    def keys(self, grams: np.ndarray) -> np.ndarray:
        """The set's bucket in each band, as signed 64-bit numbers; a band's weights are its own."""
        return mix((self.signature(grams).reshape(self.bands, self.rows) * self.weight).sum(axis=1)).astype(np.int64)


def signed(join: Join, sketch: Sketch) -> DataFrame:
    """doc_id, n_shingles and cls of every row; the bucket keys of a class come with the first row a task meets."""
    n, percent = join.n, join.percent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for ids, sets in sets_of(batches, n):
            classes, keys = [], []
            for grams in sets:
                c = class_of(grams) if len(grams) else None
                # A set and the same with one n-gram more are the most similar of different sets.
                new = c is not None and c not in seen and 100 * len(grams) >= percent * (len(grams) + 1)
                classes.append(c)
                keys.append(sketch.keys(grams) if new else None)
                if new:
                    seen.add(c)
            if len(seen) > COUNTED:
                seen.clear()
            yield batch(SIGNED, ids, [len(s) for s in sets], classes, keys)

    return join.rows.mapInArrow(tidy(run), "doc_id long, n_shingles long, cls long, keys array<long>")


def star_edges(posted: DataFrame) -> DataFrame:
    """(a, b): each class of a bucket (key, cls) with the bucket's least class.  Members of a large bucket are dealt over parts."""
    centres = posted.groupBy("key").agg(F.min("cls").alias("b"), F.max("cls").alias("last")).filter("b < last").select("key", "b")
    return salted(posted, "cls").join(copied(centres), ["key", "salt"]).filter("cls <> b").select(F.col("cls").alias("a"), "b").distinct()


def minhash_dedup(documents: DataFrame, n: int = WORDS, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) and kept (whether that is the row's own) of
    every row of ``documents``."""
    join = Join(documents, n, percent)
    first = cut(signed(join, Sketch(bands, rows)))
    coarse = components(star_edges(first.filter("keys is not null").select("cls", F.explode("keys").alias("key"))))
    out = settled(join, first.select("doc_id", "n_shingles", "cls"), cut(coarse.withColumnRenamed("node", "cls")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
