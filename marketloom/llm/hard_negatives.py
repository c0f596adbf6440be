"""Hard negatives by a distributed k-nearest-neighbour join over Voronoi cells, exactly, by inner product.

Vectors are made integer (components floor(256 x)).  A row's vector gets one more component that brings all rows to the
length of the longest; an anchor's is scaled to that length.  All lie on one sphere then, where a larger inner product with
an anchor is a smaller angle to it, and angles obey the triangle inequality.

1.  Of a bounded sample of rows (SAMPLE, chosen by hash) some are pivots, as many as anchors, PIVOTS at most, each the row
    farthest from those before.  Each anchor belongs to the cell of its nearest pivot.  Inner products with the sample give each
    anchor a score that all it needs must reach (its k-th best there; none, if the sample holds fewer), that is an angle.
    A cell's bound is the largest sum of an anchor's angle to the pivot and of that angle.
2.  A row is sent to a cell only if its angle to the pivot is within the cell's bound: no anchor of the cell needs others.
    Neighbouring cells are anchor groups of about GROUP anchors; a larger cell is dealt over parts, and the rows of a
    group over slices of about SLICE rows, so that a hot cell or vector is the work of many tasks.
3.  In each (group, part, slice) the rows meet the anchors in blocks; each task passes on its best k an anchor.

Two such joins run: the first finds positives (same label), the second, by the exact scores of these, the negatives in
each positive's range of scores.  The bounds save work; no row is left out for them.

Rows whose id, label or vector is null, or which hold null or non-finite components, take no part.  Of rows with one id the
one with the smallest label, then vector, counts, once.  A shorter vector's missing components are zero.  Scores are
computed in double precision, exact below 2^53; longer vectors are refused.  Extra columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, tidy

SAMPLE, PIVOTS, GROUP, SLICE, SCALE = 2048, 256, 128, 20_000, 256
#: Rows that meet a task's anchors at once.
BLOCK = 512
#: Angles are compared with this slack, for the rounding of their cosines.
SLACK = 1e-6

PLACED = pa.schema([("grp", pa.int32()), ("part", pa.int32()), ("slice", pa.int32()), ("vec_id", pa.int64()), ("label", pa.int64()), ("vec", pa.binary()), ("positives", pa.list_(pa.int64()))])
PLACED_DDL = "grp int, part int, slice int, vec_id long, label long, vec binary, positives array<long>"
FOUND = pa.schema([("anchor_id", pa.int64()), ("nth", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])
FOUND_DDL = "anchor_id long, nth int, vec_id long, score long"


def usable(df: DataFrame, label: Column) -> DataFrame:
    """vec_id, label and vec (components in whole 256ths, as doubles) of the rows that take part, one an id."""
    vector = F.col("embedding")
    fine = vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), vector.cast("array<double>").alias("embedding"))
    rows = rows.filter("vec_id is not null and label is not null").filter(fine)
    repeated = rows.groupBy("vec_id").agg(F.count("*").alias("n")).filter("n > 1").select("vec_id")
    if not repeated.isEmpty():
        first = rows.join(repeated, "vec_id", "left_semi").groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("row")).select("vec_id", "row.*")
        rows = rows.join(repeated, "vec_id", "left_anti").unionByName(first)
    # Not F.floor, which makes a long of it.
    whole = F.transform("embedding", lambda x: F.rint(x * SCALE) - (F.rint(x * SCALE) > x * SCALE).cast("double"))
    return rows.select("vec_id", "label", whole.alias("vec"))


def vectors_of(b: pa.RecordBatch, dims: int) -> np.ndarray:
    """The vectors of packed rows, as doubles, with zeros for missing components."""
    out = np.zeros((b.num_rows, dims))
    lists = b.column("vec")
    lengths = np.diff(lists.offsets.to_numpy())
    out[np.arange(dims)[None, :] < lengths[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1.0, 1.0))


class Sphere:
    """Rows and anchors as points of one sphere, cells around its pivots, and bounds from a sample of rows."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, radius: float, pivots: int):
        self.ids, self.labels, self.vectors, self.radius = ids, labels, vectors, max(radius, 1.0)
        self.pivots = self.spread_out(self.members(vectors), pivots)

    @staticmethod
    def spread_out(points: np.ndarray, n: int) -> np.ndarray:
        """The first point and, one after the other, the one farthest from those taken so far."""
        nearest, taken = points @ points[0], [0]
        while len(taken) < n:
            taken.append(int(nearest.argmin()))
            nearest = np.maximum(nearest, points @ points[taken[-1]])
        return points[taken]

    def members(self, vectors: np.ndarray) -> np.ndarray:
        """Unit vectors with one more component."""
        scaled = vectors / self.radius
        return np.hstack([scaled, np.sqrt(np.maximum(0.0, 1.0 - (scaled**2).sum(axis=1)))[:, None]])

    def seekers(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        norms = np.sqrt((vectors**2).sum(axis=1))
        return np.hstack([vectors / np.maximum(norms, 1.0)[:, None], np.zeros((len(vectors), 1))]), norms

    def cells(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each anchor's cell, and its angle to the pivot."""
        to_pivots = angles(self.seekers(vectors)[0] @ self.pivots.T)
        cell = to_pivots.argmin(axis=1)
        return cell, to_pivots[np.arange(len(cell)), cell]

    def reach(self, vectors: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The largest angle of a row that scores ``least`` with the anchor; half a turn, if any row may be needed, and
        less than any, if none is."""
        norms = self.seekers(vectors)[1]
        with np.errstate(invalid="ignore"):
            cosines = np.where(norms >= 1.0, least / np.maximum(norms * self.radius, 1.0), -1.0)
        return np.where(least == np.inf, -np.inf, angles(cosines))

    def order(self) -> np.ndarray:
        """The pivots, each followed by the nearest of those left."""
        left, out = np.ones(len(self.pivots), bool), [0]
        left[0] = False
        while left.any():
            out.append(int(np.where(left, self.pivots @ self.pivots[out[-1]], -np.inf).argmax()))
            left[out[-1]] = False
        return np.array(out)


def kth_best(scores: np.ndarray, allowed: np.ndarray, k: int) -> np.ndarray:
    """The k-th best allowed score of each row; minus infinity where there are fewer."""
    if scores.shape[1] < k:
        return np.full(len(scores), -np.inf)
    return np.partition(np.where(allowed, scores, -np.inf), -k, axis=1)[:, -k]


class Best:
    """The best k (score, then smaller id) of each place so far."""

    def __init__(self, places: int, k: int):
        self.k, self.least = k, np.full(places, -np.inf)
        self.place, self.ids, self.scores = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, place: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        if not len(place):
            return
        place, ids, scores = (np.concatenate(x) for x in ((self.place, place), (self.ids, ids), (self.scores, scores.astype(np.int64))))
        order = np.lexsort((ids, -scores, place))
        place = place[order]
        start = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        nth = np.arange(len(place)) - np.repeat(start, np.diff(np.append(start, len(place))))
        kept = nth < self.k
        self.place, self.ids, self.scores = place[kept], ids[order][kept], scores[order][kept]
        full = nth == self.k - 1
        self.least[place[full]] = scores[order][full]


def meet(anchors: list[dict], dims: int, kind: str, k: int, ranges: bool, blocks: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """The best k rows of the ``blocks`` (ids, labels, vectors) for each anchor, or for each positive of an anchor."""
    ids, labels = (np.array([a[c] for a in anchors], np.int64) for c in ("vec_id", "label"))
    own = np.frombuffer(b"".join(a["vec"] for a in anchors), kind).reshape(len(anchors), dims).astype(np.float64)
    if ranges:
        scores = [np.array(a["positives"], np.int64) for a in anchors]
        row = np.repeat(np.arange(len(anchors)), [len(s) for s in scores])
        nth, positive = np.concatenate([np.arange(len(s)) for s in scores]), np.concatenate(scores)
    else:
        row = np.arange(len(anchors))
        nth, positive = np.zeros(len(anchors), np.int64), None
    best = Best(len(row), k)
    for got, got_labels, vectors in blocks:
        all_scores = own @ vectors.T
        same = labels[:, None] == got_labels[None, :]
        if ranges:
            s = all_scores[row]
            fine = ~same[row] & (100 * s >= 30 * positive[:, None]) & (100 * s <= 90 * positive[:, None])
        else:
            s, fine = all_scores, same & (ids[:, None] != got[None, :])
        at, what = np.nonzero(fine & (s >= best.least[:, None]))
        best.add(at, got[what], s[at, what])
    yield pa.RecordBatch.from_arrays([pa.array(ids[row][best.place]), pa.array(nth[best.place].astype(np.int32)), pa.array(best.ids), pa.array(best.scores)], schema=FOUND)


class Join:
    """Both joins over one table of rows (vec_id, label, vec)."""

    def __init__(self, rows: DataFrame, is_anchor: Column, sample: int = SAMPLE, pivots: int = PIVOTS, group: int = GROUP, slice_rows: int = SLICE):
        self.rows, self.is_anchor, self.group, self.slice_rows = rows, is_anchor, group, slice_rows
        square = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
        largest = F.aggregate("vec", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))
        facts = rows.agg(F.max(F.size("vec")).alias("dims"), F.max(square).alias("square"), F.max(largest).alias("most"), F.count(F.when(is_anchor, 1)).alias("n_anchors")).first()
        self.n_anchors, self.dims = facts["n_anchors"], max(facts["dims"] or 0, 1)
        most = facts["most"] or 0.0
        if self.dims * most**2 >= 1 << 53:
            raise ValueError(f"components of up to {most:.0f} in {self.dims} dimensions give scores beyond 2^53, which doubles don't hold exactly")
        self.kind = "i2" if most < 1 << 15 else "i4" if most < 1 << 31 else "f8"
        got = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow().combine_chunks().to_batches() if self.n_anchors else []
        if got:
            one = got[0]
            n_pivots = min(pivots, one.num_rows, self.n_anchors)
            self.sphere = Sphere(one.column("vec_id").to_numpy(), one.column("label").to_numpy(), vectors_of(one, self.dims), np.sqrt(facts["square"]), n_pivots)

    def joined(self, anchors: DataFrame, k: int, ranges: bool) -> DataFrame:
        """(anchor_id, nth, vec_id, score): the best k rows of each of ``anchors`` (vec_id, label, vec, positives)."""
        spark, dims, kind = self.rows.sparkSession, self.dims, self.kind
        held = spark.sparkContext.broadcast(self.sphere)  # SAMPLE rows at most

        def needed(b: pa.RecordBatch, vectors: np.ndarray) -> np.ndarray:
            """What the rows that an anchor needs score at least."""
            sphere, ids, labels = held.value, b.column("vec_id").to_numpy(), b.column("label").to_numpy()
            scores, same = vectors @ sphere.vectors.T, labels[:, None] == sphere.labels[None, :]
            if not ranges:
                return kth_best(scores, same & (ids[:, None] != sphere.ids[None, :]), k)
            out = np.full(b.num_rows, np.inf)
            positives = b.column("positives").to_pylist()
            for nth in range(max(map(len, positives), default=0)):
                # No score is in the range of a negative one.
                p = np.array([float(s[nth]) if nth < len(s) and s[nth] >= 0 else np.nan for s in positives])[:, None]
                fine = ~same & (100 * scores >= 30 * p) & (100 * scores <= 90 * p)
                out = np.fmin(out, np.maximum(0.3 * p[:, 0], kth_best(scores, fine, k)))
            return out - 1.0

        def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = len(held.value.pivots)
            most, count = np.full(n, -1.0), np.zeros(n, np.int64)
            for whole in batches:
                for at in range(0, whole.num_rows, BLOCK):
                    b = whole.slice(at, BLOCK)
                    vectors = vectors_of(b, dims)
                    cell, away = held.value.cells(vectors)
                    np.maximum.at(most, cell, away + held.value.reach(vectors, needed(b, vectors)))
                    np.add.at(count, cell, 1)
            at = np.flatnonzero(count)
            yield pa.RecordBatch.from_pydict({"cell": pa.array(at, pa.int32()), "most": most[at], "n": count[at]})

        found = anchors.mapInArrow(tidy(bounds), "cell int, most double, n long").groupBy("cell").agg(F.max("most").alias("most"), F.sum("n").alias("n")).collect()  # PIVOTS rows at most
        most, count = np.full(len(self.sphere.pivots), -np.inf), np.zeros(len(self.sphere.pivots), np.int64)
        for r in found:
            most[r["cell"]], count[r["cell"]] = r["most"] + SLACK, r["n"]
        # Groups of neighbouring cells; a cell without anchors is in none.
        group_of, n_groups, size, parts = np.full(len(count), -1), 0, 0, [1]
        for cell in self.sphere.order():
            if not count[cell]:
                continue
            if size and size + count[cell] > self.group:
                n_groups, size = n_groups + 1, 0
                parts.append(1)
            group_of[cell], size = n_groups, size + int(count[cell])
            parts[-1] = -(-size // self.group)
        n_groups += 1
        laid = spark.sparkContext.broadcast((most, group_of))

        def serves(vectors: np.ndarray) -> np.ndarray:
            """Whether each row might serve an anchor of each group."""
            most, group_of = laid.value
            near = angles(held.value.members(vectors) @ held.value.pivots.T) <= most
            return near.astype(np.float32) @ (group_of[:, None] == np.arange(n_groups)).astype(np.float32) > 0

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = np.zeros(n_groups, np.int64)
            for whole in batches:
                for at in range(0, whole.num_rows, BLOCK):
                    n += serves(vectors_of(whole.slice(at, BLOCK), dims)).sum(axis=0)
            yield pa.RecordBatch.from_pydict({"grp": pa.array(range(n_groups), pa.int32()), "n": n})

        n_rows = np.zeros(n_groups, np.int64)
        for r in self.rows.mapInArrow(tidy(counted), "grp int, n long").groupBy("grp").agg(F.sum("n").alias("n")).collect():  # PIVOTS rows at most
            n_rows[r["grp"]] = r["n"]
        n_slices, n_parts = np.maximum(1, -(-n_rows // self.slice_rows)), np.array(parts)

        def dealt(ids: np.ndarray, n: np.ndarray, salt: int) -> np.ndarray:
            mixed = (ids.astype(np.uint64) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
            return ((mixed >> np.uint64(33)) % n.astype(np.uint64)).astype(np.int64)

        def place(asking: bool):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for whole in batches:
                    for at in range(0, whole.num_rows, BLOCK):
                        b = whole.slice(at, BLOCK)
                        vectors, ids = vectors_of(b, dims), b.column("vec_id").to_numpy()
                        if asking:  # to every slice of its group
                            group = laid.value[1][held.value.cells(vectors)[0]]
                            part, n = dealt(ids, n_parts[group], 1), n_slices[group]
                            row = np.repeat(np.arange(len(ids)), n)
                            group, part, slice_ = group[row], part[row], np.concatenate([np.arange(m) for m in n])
                        else:  # to every part of the groups that it might serve
                            row, group = np.nonzero(serves(vectors))
                            slice_, n = dealt(ids[row], n_slices[group], 2), n_parts[group]
                            part = np.concatenate([np.arange(m) for m in n]) if len(n) else np.zeros(0, np.int64)
                            row, group, slice_ = (np.repeat(x, n) for x in (row, group, slice_))
                        raw = pa.array([v.tobytes() for v in vectors.astype(kind)], pa.binary())
                        at_row = pa.array(row)
                        positives = b.column("positives").take(at_row) if asking else pa.nulls(len(row), pa.list_(pa.int64()))
                        columns = [pa.array(x.astype(np.int32)) for x in (group, part, slice_)] + [b.column("vec_id").take(at_row), b.column("label").take(at_row), raw.take(at_row), positives]
                        yield pa.RecordBatch.from_arrays(columns, schema=PLACED)

            return tidy(run)

        def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, anchors, waiting = None, [], []

            def blocks(first: pa.RecordBatch):
                """The rows after the anchors of a key, block by block; stops where the next key begins."""
                b = first
                while b is not None:
                    yield b.column("vec_id").to_numpy(), b.column("label").to_numpy(), np.frombuffer(b"".join(b.column("vec").to_pylist()), kind).reshape(b.num_rows, dims).astype(np.float64)
                    b = next(pieces, None)
                    if b is not None and (b.column("positives").null_count == 0 or keyed(b) != key):
                        waiting.append(b)
                        return

            def keyed(b: pa.RecordBatch) -> tuple:
                return tuple(b.column(c)[0].as_py() for c in ("grp", "part", "slice"))

            def cut_up() -> Iterator[pa.RecordBatch]:
                """Stretches of one key, of anchors or rows only."""
                for whole in batches:
                    for at in range(0, whole.num_rows, BLOCK):
                        b = whole.slice(at, BLOCK)
                        where = np.stack([b.column(c).to_numpy() for c in ("grp", "part", "slice")] + [b.column("positives").is_null().to_numpy(zero_copy_only=False)], 1)
                        new = (np.flatnonzero((where[1:] != where[:-1]).any(axis=1)) + 1).tolist()
                        for s, e in zip([0, *new], [*new, b.num_rows]):
                            yield b.slice(s, e - s)

            pieces = cut_up()
            while (b := waiting.pop() if waiting else next(pieces, None)) is not None:
                if keyed(b) != key:
                    key, anchors = keyed(b), []
                if b.column("positives").null_count == 0:
                    anchors += b.to_pylist()
                elif anchors:
                    yield from meet(anchors, dims, kind, k, ranges, blocks(b))

        columns = ["vec_id", "label", "vec"]
        both = anchors.mapInArrow(place(True), PLACED_DDL).unionByName(self.rows.select(columns).mapInArrow(place(False), PLACED_DDL))
        met = both.repartition("grp", "part", "slice").sortWithinPartitions("grp", "part", "slice", F.col("positives").isNull())
        found = met.select(*PLACED.names).mapInArrow(tidy(local), FOUND_DDL)
        order = Window.partitionBy("anchor_id", "nth").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    def positives(self, k: int) -> DataFrame:
        """(anchor_id, positive_id, positive_score) of the first ``k`` other rows of an anchor's label."""
        anchors = self.rows.filter(self.is_anchor).withColumn("positives", F.array().cast("array<bigint>"))
        return self.joined(anchors, k, ranges=False).select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))

    def negatives(self, positives: DataFrame, k: int) -> DataFrame:
        """The first ``k`` rows of another label in the range of scores of each of ``positives``."""
        scores = positives.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct(-F.col("positive_score"), "positive_id"))).alias("ranked"))
        asked = scores.select(F.col("anchor_id").alias("vec_id"), F.transform("ranked", lambda x: -x["col1"]).alias("positives"), F.col("ranked.positive_id").alias("named"))
        found = self.joined(self.rows.join(asked.drop("named"), "vec_id"), k, ranges=True)
        named = asked.select(F.col("vec_id").alias("anchor_id"), F.posexplode(F.arrays_zip("named", "positives")).alias("nth", "p"))
        return found.join(named, ["anchor_id", "nth"]).select("anchor_id", F.col("p.named").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("p.positives").alias("positive_score"), F.col("score").alias("negative_score"))


def hard_negatives(df: DataFrame, is_anchor: Column, label: Column, n_positives: int = 5, n_negatives: int = 10, **sizes: int) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score and negative_score: for each anchor and each of its
    first ``n_positives`` rows of the same label the first ``n_negatives`` rows of other labels that score between 0.3 and
    0.9 times as much.  ``is_anchor`` is a condition on vec_id."""
    rows = usable(df, label)
    join = Join(rows, is_anchor, **sizes)
    if not join.n_anchors:
        return df.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return join.negatives(cut(join.positives(n_positives)), n_negatives)
