"""Approximate nearest neighbours by multiprobe p-stable hashing, with exact distance reranking.

Rows are dealt into bands of similar norm.  Vectors are scaled by the largest norm of their band and given one more
component that makes all norms 1, so that the nearest in Euclidean distance is the one with the largest inner product.
Each of a band's ``tables`` hash tables cuts ``hashes`` Gaussian projections into cells of one width.  A query visits,
in every band, its own cell and the ``probes - 1`` perturbed cells whose boundaries are nearest (in estimated success
order, by the sum of squared distances to the boundaries).

The width is set by measured recall: ``SAMPLE`` queries are searched exactly, and a band's cells are widened from
``width`` on until the share ``RECALL`` of the sample's true neighbours in that band lie in visited cells.  A band for
which no width is enough is a single bucket that every query visits.

Members and probes of a bucket meet in one place, where all candidates are ranked by exact inner product in double
precision; each task merges its tables' candidates and passes on its best ``k`` a query.

Buckets with over ``HOT_BUCKET`` members are split; their probes go to each part.  A query for which the buckets
yield fewer than ``k`` neighbours is searched against all rows, in blocks.  Nothing is capped or dropped.

Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do those whose length is
not the table's most common one.  Ties go to the smaller id.  Rows without id take no part.  Of rows with one id the one
with the smallest vector (as an array) counts, once.  Extra columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

TABLES, HASHES, WIDTH, PROBES, SEED = 8, 6, 2.0, 18, 20_011
HOT_BUCKET = 20_000
#: Share of true neighbours to be found, of this many queries; a band's rows have norms within the factor BAND (the last of BANDS: any).
RECALL, SAMPLE, BAND, BANDS = 0.95, 100, 1.5, 8
#: Rows of the best-so-far table of a task after which it is passed on and begun anew.
HELD = 2_000_000
ROUTED = pa.schema([("tab", pa.int32()), ("bucket", pa.int64()), ("is_query", pa.bool_()), ("vec_id", pa.int64()), ("vec", pa.binary())])
ROUTED_DDL = "tab int, bucket long, is_query boolean, vec_id long, vec binary"
FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def usable(df: DataFrame, is_query: Column) -> DataFrame:
    vector = F.col("embedding")
    fine = vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(vector, lambda x: x != 0)
    return df.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("embedding"), is_query.alias("is_query")).filter(F.col("vec_id").isNotNull()).filter(fine)


def once(rows: DataFrame) -> DataFrame:
    """One row an id.  Only ids are shuffled, unless some repeat: then their rows are."""
    repeated = rows.groupBy("vec_id").agg(F.count("*").alias("n")).filter("n > 1").select("vec_id")
    if repeated.isEmpty():
        return rows
    first = rows.join(repeated, "vec_id", "left_semi").groupBy("vec_id").agg(F.min("embedding").alias("embedding"), F.bool_or("is_query").alias("is_query"))
    return rows.join(repeated, "vec_id", "left_anti").unionByName(first)


def cells(points: np.ndarray, table: int, hashes: int, width: float) -> np.ndarray:
    """Position of each point along each projection of a table, in cells."""
    rng = np.random.default_rng([SEED, table])
    return (points @ rng.standard_normal((points.shape[1], hashes)) + rng.uniform(0, width, hashes)) / width


def bucket_keys(cell: np.ndarray) -> np.ndarray:
    out = np.zeros(cell.shape[:-1], np.int64)
    for j in range(cell.shape[-1]):
        out = out * np.int64(1_000_003) + cell[..., j].astype(np.int64)
    return out


def probe_order(inside: np.ndarray, probes: int) -> np.ndarray:
    """For each query (rows: position within its cell, 0 to 1) the ``probes`` best perturbations, best first.

    Projection by projection: the best perturbations of the first j go on from the best of the first j - 1, so the work
    grows with the number of hashes, not with the number of perturbations.
    """
    cost, steps = np.zeros((len(inside), 1)), np.zeros((len(inside), 1, 0), np.int8)
    for x in inside.T:
        total = (cost[:, :, None] + np.stack([x**2, np.zeros_like(x), (1 - x) ** 2], -1)[:, None, :]).reshape(len(x), -1)
        kept = np.argsort(total, axis=1, kind="stable")[:, :probes]
        cost = np.take_along_axis(total, kept, axis=1)
        steps = np.concatenate([np.take_along_axis(steps, kept[:, :, None] // 3, axis=1), (kept % 3 - 1).astype(np.int8)[:, :, None]], axis=2)
    return steps


def tuned_width(queries: np.ndarray, asked_by: np.ndarray, members: np.ndarray, first: int, tables: int, hashes: int, width: float, probes: int) -> float | None:
    """The width from ``width`` on at which RECALL of the pairs (members, each with its query's row) meet; None if none does."""
    for _ in range(40):
        met = np.zeros(len(members), bool)
        for t in range(first, first + tables):
            place = cells(queries, t, hashes, width)
            home = np.floor(place)
            steps = probe_order(place - home, probes)
            offset = np.floor(cells(members, t, hashes, width)) - home[asked_by]
            met |= (steps[asked_by] == offset[:, None, :]).all(axis=2).any(axis=1)
        if met.sum() >= RECALL * len(met):
            return width
        width *= 1.1
    return None


def as_members(vectors: np.ndarray, largest: float) -> np.ndarray:
    scaled = vectors / np.sqrt(largest)
    return np.hstack([scaled, np.sqrt(np.maximum(0, 1 - (scaled**2).sum(axis=1)))[:, None]])


def as_seekers(vectors: np.ndarray) -> np.ndarray:
    return np.hstack([vectors / np.sqrt((vectors**2).sum(axis=1))[:, None], np.zeros((len(vectors), 1))])


class Best:
    """The best k of each query so far."""

    def __init__(self, k: int):
        self.k, self.rows = k, {}

    def add(self, query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        rough = queries @ vectors.T
        rough[query_ids[:, None] == ids[None, :]] = -np.inf
        k = min(self.k, rough.shape[1])
        cut_at = np.partition(rough, -k, axis=1)[:, -k]
        slack = 1e-9 * (1 + np.abs(cut_at))  # sums in other orders differ by less
        for r, q in enumerate(query_ids.tolist()):
            old = self.rows.get(q)
            least = cut_at[r] if old is None or len(old[0]) < self.k else max(cut_at[r], old[1][-1])
            at = np.flatnonzero(rough[r] >= max(least - slack[r], np.finfo(float).min))
            if not len(at):
                continue
            new_ids, scores = ids[at], (vectors[at] * queries[r]).sum(axis=1)
            if old is not None:
                new_ids, scores = np.concatenate([old[0], new_ids]), np.concatenate([old[1], scores])
                new_ids, first = np.unique(new_ids, return_index=True)
                scores = scores[first]
            order = np.lexsort((new_ids, -scores))[: self.k]
            self.rows[q] = new_ids[order], scores[order]

    def __len__(self) -> int:
        return len(self.rows) * self.k

    def take(self) -> pa.RecordBatch:
        n = [len(v[0]) for v in self.rows.values()]
        out = pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.fromiter(self.rows, np.int64, len(n)), n)), pa.array(np.concatenate([v[0] for v in self.rows.values()])), pa.array(np.concatenate([v[1] for v in self.rows.values()]))], schema=FOUND
        )
        self.rows = {}
        return out


def search(routed: DataFrame, keys: list[str], k: int, kind: str) -> DataFrame:
    """(query_id, vec_id, score) of the best k within each task.  Rows with equal ``keys`` meet; queries come first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, now, query_ids, queries = Best(k), None, [], []
        for b in batches:
            if not b.num_rows:
                continue
            ids, asks = b.column("vec_id").to_numpy(zero_copy_only=False), b.column("is_query").to_numpy(zero_copy_only=False)
            vectors = np.frombuffer(b"".join(b.column("vec").to_pylist()), kind).reshape(b.num_rows, -1).astype(np.float64)
            where = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in keys], 1)
            new = np.flatnonzero((where[1:] != where[:-1]).any(axis=1) | (asks[1:] != asks[:-1])) + 1
            for s, e in zip([0, *new], [*new, b.num_rows]):
                if now is None or (where[s] != now).any():
                    now, query_ids, queries = where[s], [], []
                if asks[s]:
                    query_ids.append(ids[s:e])
                    queries.append(vectors[s:e])
                elif queries:
                    q_ids, q = np.concatenate(query_ids), np.concatenate(queries)
                    for at in range(0, len(q_ids), 512):
                        best.add(q_ids[at : at + 512], q[at : at + 512], ids[s:e], vectors[s:e])
                        if len(best) > HELD:
                            yield best.take()
        if best.rows:
            yield best.take()

    sorted_rows = routed.repartition(*keys).sortWithinPartitions(*keys, F.col("is_query").desc())
    return sorted_rows.select(*keys, "is_query", "vec_id", "vec").mapInArrow(run, "query_id long, vec_id long, score double")


def ranked(found: DataFrame, k: int) -> DataFrame:
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def nearest(df: DataFrame, is_query: Column, k: int = 20, tables: int = TABLES, hashes: int = HASHES, width: float = WIDTH, probes: int = PROBES) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest found for each row where ``is_query`` holds."""
    kind = "f4" if "float" in dict(df.dtypes)["embedding"] else "f8"
    rows = once(usable(df, is_query))
    square = F.aggregate(F.col("embedding"), F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    facts = rows.groupBy(F.size("embedding").alias("dims")).agg(F.count("*").alias("n"), F.max(square).alias("largest")).orderBy(F.desc("n"), "dims").first()
    empty = df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if facts is None:
        return empty
    dims, n_rows, top = facts["dims"], facts["n"], facts["largest"]
    shorter = F.nanvl(F.floor((F.log(F.lit(top)) - F.log(square)) / (2 * np.log(BAND))).cast("double"), F.lit(BANDS - 1.0))
    band = F.least(F.greatest(F.coalesce(shorter, F.lit(BANDS - 1.0)), F.lit(0.0)), F.lit(BANDS - 1.0)).cast("int")
    rows = rows.filter(F.size("embedding") == dims).withColumn("band", band)
    bands = {r["band"]: (r["n"], r["largest"]) for r in rows.groupBy("band").agg(F.count("*").alias("n"), F.max(square).alias("largest")).collect()}

    def vectors_of(b: pa.RecordBatch) -> np.ndarray:
        return b.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(b.num_rows, dims)

    widths = dict.fromkeys(bands)
    if bands:
        sample = rows.filter("is_query").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow().combine_chunks().to_batches()
        if not sample:
            return empty
        sample_ids, sampled = sample[0].column("vec_id").to_numpy(zero_copy_only=False), vectors_of(sample[0]).astype(np.float64)

        def exactly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = Best(k)
            for whole in batches:
                for at in range(0, whole.num_rows, 1000):
                    b = whole.slice(at, 1000)
                    best.add(sample_ids, sampled, b.column("vec_id").to_numpy(zero_copy_only=False), vectors_of(b).astype(np.float64))
            if best.rows:
                yield best.take()

        near = ranked(rows.mapInArrow(exactly, "query_id long, vec_id long, score double"), k).join(rows, "vec_id").select("query_id", "band", "embedding").toArrow().combine_chunks().to_batches()
        row_of = {q: at for at, q in enumerate(sample_ids.tolist())}
        for n, (size, largest) in bands.items():
            at = np.flatnonzero(near[0].column("band").to_numpy(zero_copy_only=False) == n) if near else np.array([], int)
            asked_by = np.array([row_of[q] for q in near[0].column("query_id").take(pa.array(at)).to_pylist()], int) if len(at) else at
            members = as_members(vectors_of(near[0])[at].astype(np.float64), largest) if len(at) else np.zeros((0, dims + 1))
            widths[n] = tuned_width(as_seekers(sampled), asked_by, members, n * tables, tables, hashes, width, probes)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(tab: int, keys: np.ndarray, asking: bool, ids: np.ndarray, raw: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), tab, np.int32)), pa.array(keys), pa.array(np.full(len(ids), asking)), pa.array(ids), raw], schema=ROUTED)

        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                original, asks = vectors_of(b), b.column("is_query").to_numpy(zero_copy_only=False).astype(bool)
                x, ids, its_band = original.astype(np.float64), b.column("vec_id").to_numpy(zero_copy_only=False), b.column("band").to_numpy(zero_copy_only=False)
                raw = pa.array([v.tobytes() for v in original], pa.binary())
                seekers, asking = as_seekers(x[asks]), raw.take(pa.array(np.flatnonzero(asks)))
                for n, (_, largest) in bands.items():
                    here, cell_width = np.flatnonzero(its_band == n), widths[n]
                    own = raw.take(pa.array(here))
                    members = as_members(x[here], largest)
                    for t in range(n * tables, n * tables + (1 if cell_width is None else tables)):
                        keys = np.zeros(len(here), np.int64) if cell_width is None else bucket_keys(np.floor(cells(members, t, hashes, cell_width)))
                        if len(here):
                            yield sent(t, keys, False, ids[here], own)
                        if not len(seekers):
                            continue
                        if cell_width is None:
                            yield sent(t, np.zeros(len(seekers), np.int64), True, ids[asks], asking)
                            continue
                        place = cells(seekers, t, hashes, cell_width)
                        home = np.floor(place)
                        probed = bucket_keys(home[:, None, :] + probe_order(place - home, probes))
                        for p in range(probed.shape[1]):
                            yield sent(t, probed[:, p], True, ids[asks], asking)

    routed = rows.mapInArrow(route, ROUTED_DDL)
    hot = routed.filter(~F.col("is_query")).groupBy("tab", "bucket").agg(F.ceil(F.count("*") / HOT_BUCKET).cast("int").alias("parts")).filter("parts > 1")
    split = routed.join(hot, ["tab", "bucket"], "left")
    parts = F.coalesce("parts", F.lit(1))
    own = F.array(F.pmod(F.xxhash64("vec_id"), parts).cast("int"))
    salted = split.withColumn("part", F.explode(F.when(F.col("is_query"), F.sequence(F.lit(0), parts - 1)).otherwise(own)))
    # Looked at twice: for what was found, and for queries that found too few.
    found = cut(ranked(search(salted, ["tab", "bucket", "part"], k, kind), k))
    wanted = min(k, n_rows - 1)
    lacking = rows.filter("is_query").join(found.groupBy("query_id").agg(F.count("*").alias("have")).filter(F.col("have") >= wanted), F.col("vec_id") == F.col("query_id"), "left_anti")
    if wanted and not lacking.isEmpty():
        blocks = int(np.ceil(n_rows / HOT_BUCKET))

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    raw = pa.array([v.tobytes() for v in vectors_of(b)], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(np.zeros(b.num_rows, np.int32)), pa.array(np.zeros(b.num_rows, np.int64)), b.column("is_query"), b.column("vec_id"), raw], schema=ROUTED)

        members = rows.withColumn("is_query", F.lit(False)).mapInArrow(pack, ROUTED_DDL).withColumn("bucket", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
        seekers = lacking.mapInArrow(pack, ROUTED_DDL).withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")))
        whole = ranked(search(members.unionByName(seekers), ["tab", "bucket"], k, kind), k)
        found = found.join(lacking.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(whole)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
