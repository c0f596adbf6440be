"""Connected components of a table of links, on the cluster."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, cut, tidy
from .rolling import roots

#: Links that a task holds at most, two numbers each.
TASK_LINKS = 1_000_000

LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])
ROOTS = pa.schema([("node", pa.int64()), ("root", pa.int64())])


def rooted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the links (a, b), and the place of the smallest node of each one's component among them."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    return nodes, roots(len(nodes), at[: len(a)], at[len(a) :])


def forest(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Links of each node to the smallest of its component, by the links (a, b)."""
    nodes, root = rooted(a, b)
    own = np.flatnonzero(root != np.arange(len(nodes)))
    return batch(LINKS, pa.array(nodes[own]), pa.array(nodes[root[own]]))


def ends(links: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.concatenate([x.column(c).to_numpy() for x in links]) for c in ("a", "b"))


def forests(links: DataFrame) -> DataFrame:
    """Fewer links (a, b), a > b, that join the same nodes: a forest of each task's, or of each TASK_LINKS of them."""
    most = TASK_LINKS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size > most:
                held = [forest(*ends(held))]
                size = held[0].num_rows
                if 2 * size > most:
                    yield from held
                    held, size = [], 0
        if held:
            yield forest(*ends(held))

    return links.filter("a <> b").select("a", "b").mapInArrow(tidy(run), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of each node of ``links`` (a, b), where root is the smallest node of its component.

    Each task first joins its own links, so that a forest of each is left.  If these have TASK_LINKS links or fewer, which
    a task can hold whatever the input, it joins them and no round is needed; else they are joined by rounds over all tasks.
    """
    pairs = cut(forests(links))
    if pairs.count() > TASK_LINKS:
        return joined_in_rounds(pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held := list(batches):
            nodes, root = rooted(*ends(held))
            yield batch(ROOTS, pa.array(nodes), pa.array(nodes[root]))

    return cut(pairs.coalesce(1).mapInArrow(tidy(run), "node long, root long"))


def joined_in_rounds(links: DataFrame) -> DataFrame:
    """The same for any number of links.

    Alternates two steps until only stars are left: each node passes its smallest neighbour on to its larger
    neighbours, then to its smaller ones.  Smallest neighbours are aggregated before they are shuffled, so a node with
    any number of links is no hot spot.  Each round's links are written to the checkpoint folder; none reach the driver.
    """
    pairs = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        # All are stars around their roots if no smaller end of a link is also a larger end and no larger end has two.
        if pairs.join(pairs.select(F.col("a").alias("b")), "b", "left_semi").isEmpty() and pairs.groupBy("a").count().filter("count > 1").isEmpty():
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        pairs = cut(large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*").filter("a <> b").distinct())
