"""Exact Jaccard join of documents on word n-grams, as a blocked sparse matrix product.

A document's set holds the hashes of its distinct word n-grams.  Documents with equal sets are one class, so copies
never meet as pairs.  Two sets with Jaccard similarity t or more share one of their first n - ceil(t n) + 1 n-grams
in any order fixed for all sets; here the order is rare first (by approximate counts of repeated n-grams over all
documents, then by hash), so that frequent passages hardly ever bring documents together.

1.  Counts of repeated n-grams, and each document's class and size.
2.  Postings of the first n-grams, dealt by n-gram as packed arrays.  Pairs of a short list are counted; those that
    share too few of their first n-grams for the overlap that their sizes demand are discarded (what follows a set's
    first n-grams can't make up for it), the rest are joined to coarse components.  In a long list classes of
    neighbouring size are joined.  No pair outside a coarse component can reach the bound.
3.  Sets of classes in coarse components meet in blocks of bounded size.  A small component is one block.  Of a large one
    each class is sent once, to a block of its size, where it also meets a few pivots of the component; classes that are
    joined by way of a pivot need not meet again, so only blocks of classes that are not yet joined, of neighbouring
    sizes, meet in pairs.  A group of near copies of any size is sent once, not once a block.  Each block is a sparse incidence matrix of classes by n-grams; its product
    with its transpose accumulates overlap counts, rare columns by pairs and frequent ones densely.  Pairs below the
    bound that their sizes imply are discarded; the rest are links.
4.  Components of the links, then of the documents.

A document with fewer than n words is one n-gram of its whole sequence.  Null, empty and blank texts have no n-grams
and are linked with nothing.  Hashes have 64 bits.  A null id belongs to its class and is never a component's id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, cut, plain_ids, slices, texts, tidy
from .graph import components, forest
from .rolling import BASE, POWERS, VALUES, mix, roots  # noqa: F401

WORDS, PERCENT = 5, 75
#: Bytes of text hashed together, n-grams counted together, postings packed together, and slots of the table of counts
#: (fixed, so its broadcast is).
STRETCH, COUNTED, PACKED, COUNT_SLOTS = 1_000_000, 5_000_000, 2_000_000, 1 << 20
#: Bits of the filter of classes in coarse components (fixed, so its broadcast is; it only saves shuffling).
FILTER_BITS = 1 << 23
#: Classes and n-grams of a block.
BLOCK_CLASSES, BLOCK_GRAMS = 512, 2_000_000
#: Pivots of a size of a large component, at most.
PIVOTS = 8
#: First n-grams that a slot holds on average at most (a worker sorts one slot at a time), and parts into which the rows
#: of a component or class are dealt for joins, so that a large one meets in no single task.
SLOT_GRAMS, SALT = 4_000_000, 16
#: Lists of an n-gram up to this long are looked at pair by pair.
SHORT_LIST = 12
#: Columns with more classes than this are multiplied densely.
DENSE = 8

FOLD = np.arange(256, dtype=np.uint8)
FOLD[ord("A") : ord("Z") + 1] += 32
BLANK = np.zeros(256, bool)
BLANK[[32, *range(9, 14)]] = True
WORD_VALUES = np.where(BLANK, np.uint64(0), VALUES)

FIRST = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("cls", pa.int64()), ("slot", pa.int32()), ("n", pa.int64())])
POSTED = pa.schema([("slot", pa.int32()), ("grams", pa.binary()), ("classes", pa.binary()), ("sizes", pa.binary())])
SHARED = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("size_a", pa.int64()), ("size_b", pa.int64()), ("n", pa.int64())])
#: Stands for enough shared n-grams.
ENOUGH = 1 << 40
SETS = pa.schema([("cls", pa.int64()), ("grams", pa.binary())])


def shingle_sets(rows: list[str], n: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text."""
    raw = [t.encode("utf-8", "surrogatepass") + b" " for t in rows]
    data = FOLD[np.frombuffer(b"".join(raw), np.uint8)]
    blank = BLANK[data]
    starts = np.flatnonzero(~blank & np.append(True, blank[:-1]))
    ends = np.cumsum([len(r) for r in raw])
    first = np.concatenate([[0], np.searchsorted(starts, ends)])  # each text's range of words
    if not len(starts):
        return [np.zeros(0, np.uint64)] * len(rows)
    up, down = POWERS.reach(len(data))
    words = mix(np.add.reduceat(WORD_VALUES[data] * up, starts) * down[starts])
    grams, k = np.zeros(max(len(words) - n + 1, 0), np.uint64), np.uint64(BASE)
    for j in range(n):
        grams = grams * k + words[j : j + len(grams)]
    grams = mix(grams)
    out = []
    for s, e in zip(first.tolist(), first[1:].tolist()):
        if e - s >= n:
            out.append(np.unique(grams[s : e - n + 1]))
        else:
            whole = e - s
            for w in words[s:e].tolist():
                whole = (whole * BASE + w) % (1 << 64)
            out.append(mix(np.array([whole], np.uint64)) if e > s else np.zeros(0, np.uint64))
    return out


def class_of(grams: np.ndarray) -> int:
    """A key of a set, as a signed 64-bit number."""
    up, _ = POWERS.reach(len(grams) + 1)
    return int(mix((grams * up[: len(grams)]).sum(keepdims=True) + np.uint64(len(grams)))[0].astype(np.int64))


def sets_of(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    """doc_ids and sets of stretches of about STRETCH bytes."""
    for b in slices(batches):
        ids, rows = b.column("doc_id").to_pylist(), texts(b.column("text"))
        start, size = 0, 0
        for i, t in enumerate(rows):
            if size and size + len(t) > STRETCH:
                yield ids[start:i], shingle_sets(rows[start:i], n)
                start, size = i, 0
            size += len(t)
        if start < len(rows):
            yield ids[start:], shingle_sets(rows[start:], n)


def count_slot(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(20)) & np.uint64(COUNT_SLOTS - 1)


def prefix(grams: np.ndarray, levels: np.ndarray, percent: int) -> np.ndarray:
    """The first n-grams of a set in the order rare first, then by hash: two sets that link share one of these."""
    return grams[np.argsort(levels[count_slot(grams)], kind="stable")[: prefix_length(len(grams), percent)]]  # grams are sorted


def prefix_length(n, percent: int):
    return n - (percent * n + 99) // 100 + 1


def packed_set(grams: np.ndarray) -> bytes:
    """Six bytes of each hash, byte by byte: sorted, so the upper ones compress.  Enough to tell the n-grams of a
    block apart."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(grams.view(np.uint8).reshape(-1, 8)[:, 2:].T).tobytes())


def unpacked_set(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(6, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :6] = planes.T
    return out.view(np.uint64).ravel()


class Join:
    """The steps of the join over one table of documents."""

    def __init__(self, documents: DataFrame, n: int = WORDS, percent: int = PERCENT):
        self.rows, self.n, self.percent = plain_ids(documents, "doc_id"), n, percent
        self.spark = documents.sparkSession
        self.slots = int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def first_pass(self) -> DataFrame:
        """Rows of documents (doc_id, n_shingles, cls) and of counts (slot, n) of n-grams that a task met repeatedly."""
        n = self.n

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts, held, size = np.zeros(COUNT_SLOTS, np.int64), [], 0

            def count() -> None:
                grams, times = np.unique(np.concatenate(held), return_counts=True)
                np.add.at(counts, count_slot(grams[times > 1]), times[times > 1])

            for ids, sets in sets_of(batches, n):
                yield batch(FIRST, ids, [len(s) for s in sets], [class_of(s) if len(s) else None for s in sets], [None] * len(ids), [None] * len(ids))
                held += sets
                size += sum(map(len, sets))
                if size > COUNTED:
                    count()
                    held, size = [], 0
            if held:
                count()
            at = np.flatnonzero(counts)
            if len(at):
                none = pa.nulls(len(at), pa.int64())
                yield batch(FIRST, none, none, none, pa.array(at, pa.int32()), pa.array(counts[at]))

        return self.rows.mapInArrow(tidy(run), "doc_id long, n_shingles long, cls long, slot int, n long")

    def coarse_links(self, levels: np.ndarray) -> DataFrame:
        """(a, b) links of classes that share one of their first n-grams and may link by size."""
        n, percent, slots = self.n, self.percent, self.slots
        held = self.spark.sparkContext.broadcast(levels)

        def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[int] = set()
            parts: list[tuple[np.ndarray, int, int]] = []
            size = 0

            def packed() -> Iterator[pa.RecordBatch]:
                grams = np.concatenate([p for p, _, _ in parts])
                lengths = np.array([len(p) for p, _, _ in parts])
                classes = np.repeat(np.array([c for _, c, _ in parts], np.int64), lengths)
                sizes = np.repeat(np.array([s for _, _, s in parts], np.int32), lengths)
                slot = ((grams >> np.uint64(8)) % np.uint64(slots)).astype(np.int32)
                order = np.argsort(slot, kind="stable")
                slot = slot[order]
                columns = [c[order] for c in (grams, classes, sizes)]
                cuts = np.flatnonzero(np.diff(slot)) + 1
                for s, e in zip([0, *cuts], [*cuts, len(slot)]):
                    yield batch(POSTED, [int(slot[s])], *([zstandard.ZstdCompressor(level=1).compress(c[s:e].tobytes())] for c in columns))

            for _, sets in sets_of(batches, n):
                for grams in sets:
                    if len(grams) and (c := class_of(grams)) not in seen:
                        seen.add(c)
                        parts.append((prefix(grams, held.value, percent), c, len(grams)))
                        size += len(parts[-1][0])
                        if size > PACKED:
                            yield from packed()
                            parts, size = [], 0
                            if len(seen) > COUNTED:
                                seen.clear()
            if parts:
                yield from packed()

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, rows in by_key((r for b in batches for r in b.to_pylist()), "slot"):
                got, inflate = list(rows), zstandard.ZstdDecompressor().decompress
                grams, classes, sizes = (np.frombuffer(b"".join(inflate(r[k]) for r in got), t) for k, t in (("grams", np.uint64), ("classes", np.int64), ("sizes", np.int32)))
                yield from shared_pairs(grams, classes, sizes.astype(np.int64), percent)

        dealt = self.rows.mapInArrow(tidy(post), "slot int, grams binary, classes binary, sizes binary").repartition("slot").sortWithinPartitions("slot")
        shared = dealt.mapInArrow(tidy(meet), "a long, b long, size_a long, size_b long, n long").groupBy("a", "b", "size_a", "size_b").agg(F.sum("n").alias("n"))
        # With the shorter prefix's end at one set's, all n-grams shared beyond it are among the rest of that set.
        needed = F.expr(f"({percent} * (size_a + size_b) + {99 + percent}) div {100 + percent}")
        rest = F.expr(f"greatest(({percent} * size_a + 99) div 100, ({percent} * size_b + 99) div 100) - 1")
        return shared.filter(F.col("n") + rest >= needed).select("a", "b")

    def class_filter(self, members: DataFrame) -> np.ndarray:
        """Bits of the classes in ``members``: at most FILTER_BITS of them reach the driver, whatever the input."""
        bit = F.pmod("cls", F.lit(FILTER_BITS))
        words = members.groupBy(F.floor(bit / 32).cast("int").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(cls, {FILTER_BITS}) % 32 as int))")).alias("bits")).toArrow()
        out = np.zeros(FILTER_BITS // 32, np.int64)
        out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
        return out.astype(np.uint32)

    def candidate_sets(self, members: DataFrame) -> DataFrame:
        """(cls, grams) at least of the classes in ``members``; a class may come from several tasks."""
        n, held = self.n, self.spark.sparkContext.broadcast(self.class_filter(members))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[int] = set()
            for _, sets in sets_of(batches, n):
                out = {}
                for grams in sets:
                    if not len(grams) or (c := class_of(grams)) in seen:
                        continue
                    bit = c % FILTER_BITS
                    if held.value[bit // 32] >> np.uint32(bit % 32) & np.uint32(1):
                        seen.add(c)
                        out[c] = packed_set(grams)
                if len(seen) > COUNTED:
                    seen.clear()
                yield batch(SETS, list(out), list(out.values()))

        return self.rows.mapInArrow(tidy(run), "cls long, grams binary")

    def links(self, members: DataFrame, sizes: DataFrame) -> DataFrame:
        """(a, b) links between classes, enough of them to join all that are linked.

        ``members`` (cls, root) names each class's coarse component, ``sizes`` (cls, n_shingles) its size.
        """
        percent = self.percent
        sized = cut(members.join(sizes, "cls").withColumn("level", F.floor(F.log("n_shingles") / F.log(F.lit(100.0 / percent))).cast("int")))
        whole = sized.groupBy("root").agg(F.count("*").alias("n_classes"), F.sum("n_shingles").alias("n_grams"))
        large = whole.filter((F.col("n_classes") > BLOCK_CLASSES) | (F.col("n_grams") > BLOCK_GRAMS)).select("root")
        n_parts = F.ceil(F.greatest(F.count("*") / BLOCK_CLASSES, F.sum("n_shingles") / BLOCK_GRAMS)).cast("int").alias("parts")
        own = F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int")
        # A large component is cut by size (links reach the next level at most) and by hash within a size.
        parts = sized.join(large, "root").groupBy("root", "level").agg(n_parts)
        placed = salted(sized, "cls").join(copied(parts), ["root", "level", "salt"], "left").drop("salt")
        first = placed.select("cls", "root", F.when(F.col("parts").isNull(), "all").otherwise(F.concat_ws(":", "level", own)).alias("block"))
        picked = sized.join(large, "root").groupBy("root", "level", F.pmod(F.xxhash64("cls", F.lit(1)), F.lit(PIVOTS))).agg(F.min("cls").alias("cls"))
        near = picked.select("cls", "root", F.explode(F.array(F.col("level") - 1, F.col("level"), F.col("level") + 1)).alias("level")).join(parts, ["root", "level"])
        pivots = near.select("cls", "root", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "level").select("cls", "root", F.concat_ws(":", "level", "part").alias("block"))
        met = cut(self.block_links(members, first.unionByName(pivots).distinct()))

        # Of a large component: classes by the group that has joined them, if it has a block's classes; the others by 0.
        rest = cut(sized.join(large, "root").join(components(met).withColumnRenamed("node", "cls").withColumnRenamed("root", "grp"), "cls", "left"))
        groups = rest.filter("grp is not null").groupBy("root", "level", "grp").agg(F.count("*").alias("n")).filter(F.col("n") >= BLOCK_CLASSES).select("root", "level", "grp", F.col("grp").alias("tag"))
        tagged = salted(rest, "cls").join(copied(groups), ["root", "level", "grp", "salt"], "left").select("cls", "root", "level", "n_shingles", F.coalesce("tag", F.lit(0)).alias("tag"))
        places = cut(tagged.groupBy("root", "level", "tag").agg(n_parts))
        if places.groupBy("root").agg(F.count("*").alias("n"), F.max(F.when(F.col("tag") == 0, F.col("parts"))).alias("loose")).filter("n > 1 or loose > 1").isEmpty():
            return met
        others = places.select("root", *[F.col(c).alias(f"other_{c}") for c in ("level", "tag", "parts")])
        apart = (F.col("tag") != F.col("other_tag")) | (F.col("tag") == 0)
        meeting = places.join(others, "root").filter((F.abs(F.col("level") - F.col("other_level")) <= 1) & apart)
        sent = salted(tagged, "cls").join(copied(meeting), ["root", "level", "tag", "salt"])
        me = F.concat_ws(":", "level", "tag", own)
        routed = sent.select("cls", "root", me.alias("me"), F.explode(F.transform(F.sequence(F.lit(0), F.col("other_parts") - 1), lambda i: F.concat_ws(":", "other_level", "other_tag", i))).alias("other"))
        pairs = routed.select("cls", "root", F.concat_ws("|", F.least("me", "other"), F.greatest("me", "other")).alias("block"))
        return met.unionByName(self.block_links(rest.select("cls", "root"), pairs))

    def block_links(self, members: DataFrame, routed: DataFrame) -> DataFrame:
        """(a, b) links between the classes that ``routed`` (cls, root, block) sends to one block: a forest of each."""
        percent = self.percent
        filled = self.candidate_sets(members).join(routed, "cls").select("root", "block", "cls", "grams").repartition("root", "block").sortWithinPartitions("root", "block", "cls")

        def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = (r for b in batches for at in range(0, b.num_rows, 256) for r in b.slice(at, 256).to_pylist())
            for _, group in by_key(rows, "root", "block"):
                block = {r["cls"]: unpacked_set(r["grams"]) for r in group}
                if len(block) > 1:
                    classes = np.array(list(block), np.int64)
                    left, right = linked(list(block.values()), percent)
                    yield forest(classes[left], classes[right])

        return filled.mapInArrow(tidy(multiply), "a long, b long")


def salted(df: DataFrame, by: str) -> DataFrame:
    return df.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALT)).cast("int"))


def copied(df: DataFrame) -> DataFrame:
    """A copy of each row for each part: for tables with a row a component or a class."""
    return df.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALT)))))


def by_key(rows: Iterator[dict], *keys: str):
    from itertools import groupby
    from operator import itemgetter

    return groupby(rows, itemgetter(*keys))


def shared_pairs(grams: np.ndarray, classes: np.ndarray, sizes: np.ndarray, percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs of classes, the smaller set first, with how many of these n-grams both have; ENOUGH from long lists."""
    order = np.lexsort((classes, sizes, grams))
    order = order[np.append(True, (grams[order[1:]] != grams[order[:-1]]) | (classes[order[1:]] != classes[order[:-1]]))]
    grams, classes, sizes = grams[order], classes[order], sizes[order]
    start = np.flatnonzero(np.append(True, grams[1:] != grams[:-1]))
    length = np.diff(np.append(start, len(grams)))
    ratio = lambda a, b: 100 * sizes[a] >= percent * sizes[b]
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for d in range(2, SHORT_LIST + 1):
        own = start[length == d]
        for i in range(d):
            for j in range(i + 1, d):
                a, b = own + i, own + j
                fine = ratio(a, b)
                left.append(a[fine])
                right.append(b[fine])
    yield counted_pairs(classes, sizes, np.concatenate(left), np.concatenate(right), 1)
    # In a list sorted by size, classes that may link are joined by steps that each keep the ratio.
    step = np.flatnonzero((grams[1:] == grams[:-1]) & (np.repeat(length, length)[1:] > SHORT_LIST))
    step = step[ratio(step, step + 1)]
    yield counted_pairs(classes, sizes, step, step + 1, ENOUGH)


def counted_pairs(classes: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray, worth: int) -> pa.RecordBatch:
    order = np.lexsort((classes[b], classes[a]))
    a, b = a[order], b[order]
    new = np.flatnonzero(np.append(True, (classes[a[1:]] != classes[a[:-1]]) | (classes[b[1:]] != classes[b[:-1]]))[: len(a)])
    times = np.diff(np.append(new, len(a)))
    a, b = a[new], b[new]
    return batch(SHARED, *map(pa.array, (classes[a], classes[b], sizes[a], sizes[b], times * worth)))


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Overlap counts of all pairs: the product of the incidence matrix with its transpose, by blocks of columns."""
    m = len(sets)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(m), [len(s) for s in sets])
    out = np.zeros((m, m), np.int64)
    order = np.argsort(column, kind="stable")  # rows ascend within a column
    row, start = row[order], np.concatenate([[0], np.cumsum(times)[:-1]])
    for d in range(2, min(DENSE, m) + 1):
        cols = start[times == d]
        if len(cols):
            members = row[cols[:, None] + np.arange(d)]
            i, j = np.triu_indices(d, 1)
            flat = (members[:, i] * m + members[:, j]).ravel()
            out += np.bincount(flat, minlength=m * m).reshape(m, m)
    frequent = np.flatnonzero(times > DENSE)
    for at in range(0, len(frequent), 4096):
        cols = frequent[at : at + 4096]
        part = np.zeros((m, len(cols)), np.float32)
        lengths = times[cols]
        places = np.repeat(start[cols] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
        part[row[places], np.repeat(np.arange(len(cols)), lengths)] = 1
        out += np.triu(np.rint(part @ part.T).astype(np.int64), 1)
    return out


def linked(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i < j) of sets with 100 * overlap >= percent * union."""
    shared = overlaps(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    bound = percent * (sizes[:, None] + sizes[None, :])  # (100 + percent) * overlap must reach it
    return np.nonzero(np.triu((100 + percent) * shared >= bound, 1))


def classes_of(rows: DataFrame) -> DataFrame:
    return rows.filter("cls is not null").groupBy("cls").agg(F.first("n_shingles").alias("n_shingles"), F.min("doc_id").alias("least"), F.count("*").alias("n_rows"))


def settled(join: Join, rows: DataFrame, members: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of ``rows`` (doc_id, n_shingles, cls), by the links that the sets of
    ``members`` (cls, root: its coarse component) confirm."""
    classes = classes_of(rows)
    roots_of = components(join.links(members, classes.select("cls", "n_shingles"))).withColumnRenamed("node", "cls")
    # Components of one class need no join; the others' rows are dealt over parts.
    linked_ = roots_of.join(classes.select("cls", "least"), "cls")
    ids = linked_.groupBy("root").agg(F.min("least").alias("component_id"))
    joined = salted(roots_of, "cls").join(copied(ids), ["root", "salt"]).select("cls", "component_id")
    named = classes.join(joined, "cls", "left").filter("n_rows > 1 or component_id is not null").select("cls", F.coalesce("component_id", "least").alias("component_id"))
    # So are the copies of a text.
    out = salted(rows, "doc_id").join(copied(named), ["cls", "salt"], "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def jaccard_join(documents: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links) of every row of ``documents``."""
    join = Join(documents, n, percent)
    first = cut(join.first_pass())
    rows = first.filter("n_shingles is not null").select("doc_id", "n_shingles", "cls")
    classes = classes_of(rows)
    level = F.floor(F.log2(1 + F.sum("n"))).cast("byte")
    counted = first.filter("slot is not null").groupBy("slot").agg(level.alias("level")).toArrow()  # COUNT_SLOTS rows at most
    levels = np.zeros(COUNT_SLOTS, np.uint8)
    levels[counted.column("slot").to_numpy()] = counted.column("level").to_numpy()
    del counted
    pa.default_memory_pool().release_unused()
    n_first = classes.agg(F.sum(F.expr(f"n_shingles - ({percent} * n_shingles + 99) div 100 + 1"))).first()[0] or 0
    join.slots = max(join.slots, -(-int(n_first) // SLOT_GRAMS))
    return settled(join, rows, cut(components(join.coarse_links(levels)).withColumnRenamed("node", "cls")))
