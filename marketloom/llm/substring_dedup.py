"""Removal of substrings of ``length`` bytes that a document with a smaller id holds too.

Each byte covered by a ``length``-byte string that also starts in a document with a smaller id goes; strings are
judged on the input.  Texts are UTF-8 bytes and matches never cross documents.

To bring equal strings together without shuffling every position, each string is filed under its anchor: the
leftmost of its ``ANCHOR``-byte substrings with the smallest hash, the same wherever the string stands.  Neighbouring
strings mostly share an anchor, so there is about one anchor for every ``(length - ANCHOR) / 2`` bytes.

1.  Anchors' hashes and documents, packed, are dealt by hash; those that two documents hold are kept.
2.  They go to their documents' texts, where the strings around them are cut out.  Strings that a text beside them
    holds under a smaller id are settled there; so a frequent passage leaves a task once, not once a copy.
3.  The others are dealt by anchor.  The strings of an anchor are sorted by hash-compared suffixes (``suffix_sort``);
    those that a smaller document holds are removed.
4.  The removed ranges go to the texts.

Steps move packed arrays by a number of slots: ``spark.sql.shuffle.partitions``, or more where the plan's statistics
say that the input is large, so that a slot, which a worker holds whole, stays small.  An anchor's strings meet in one
slot, less those settled before: where a passage stands in very many documents amid ever other words, the strings at
its two ends that cover such words all go to that slot.
Null and empty texts, and texts shorter than ``length``, lose nothing.  Rows without id come after all others; rows
with one id do not count as each other's source.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, known_size, plain_ids
from .rolling import between, mix, prefix_hashes
from .suffix_sort import Comparer, equal_runs

LENGTH, ANCHOR = 50, 24
#: Bytes of text hashed together, anchors packed together, strings sorted together.
STRETCH, PACKED, SORTED = 1_000_000, 1_500_000, 250_000
#: Bytes of input (as the plan's statistics count them) for a slot, and the slots that a key has bits for: a slot stays of
#: this size up to 268 TB of input.
SLOT_BYTES, SLOTS = 16_000_000, 1 << 24
#: A key's lower bits are its anchor's hash, the others its slot.
KEY_BITS, KEY_BYTES = np.uint64(40), 5
#: Stands for a null id: after all others.
NO_ID = np.iinfo(np.int64).max
PARCEL = pa.schema([("slot", pa.int32()), ("kind", pa.int32()), ("doc_id", pa.int64()), ("x", pa.binary()), ("y", pa.binary()), ("z", pa.binary())])
PARCEL_DDL = "slot int, kind int, doc_id long, x binary, y binary, z binary"
RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])
FINDINGS, RANGES, TEXT = 0, 1, 2


def packed(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def unpacked(raw: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), kind)


def joined(parts: list[np.ndarray], kind: type) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def doc_slot(ids: np.ndarray, slots: int) -> np.ndarray:
    return (mix(ids.astype(np.uint64)) % np.uint64(slots)).astype(np.int32)


def key_slot(keys: np.ndarray, slots: int) -> np.ndarray:
    return ((keys >> KEY_BITS) % np.uint64(slots)).astype(np.int32)


class Anchors:
    """Anchors of the texts (as bytes) of a stretch: place, hash, first and last string filed there (as places in
    ``data``), and number of the text."""

    def __init__(self, rows: list[bytes], length: int, width: int = ANCHOR):
        self.data = np.frombuffer(b"".join(rows), np.uint8)
        self.ends = np.cumsum([len(r) for r in rows])
        self.begins = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        none = np.zeros(0, np.int64)
        self.at = self.first = self.last = self.row = none
        self.keys, self.prefix = np.zeros(0, np.uint64), np.zeros(1, np.uint64)
        n = len(self.data) - width + 1
        if n < length - width + 1:
            return
        self.prefix = prefix_hashes(self.data)
        places = np.arange(n)
        hashes = mix(between(self.prefix, places, places + width))
        # High bits of the hash, then the place: the minimum is the leftmost of the smallest.
        low = np.uint64((1 << 28) - 1)
        best = (hashes & ~low) | places.astype(np.uint64)
        reach, span = length - width + 1, 1
        while span * 2 <= reach:
            best = np.minimum(best[: len(best) - span], best[span:])
            span *= 2
        if span < reach:
            best = np.minimum(best[: len(best) - (reach - span)], best[reach - span :])
        chosen = (best & low).astype(np.int64)  # for each string of the stretch, its anchor
        row = np.repeat(np.arange(len(rows)), self.ends - self.begins)[: len(chosen)]
        starts = np.flatnonzero(np.arange(len(chosen)) + length <= self.ends[row])  # strings within one text
        if not len(starts):
            return
        chosen = chosen[starts]
        new = np.append(True, (chosen[1:] != chosen[:-1]) | (starts[1:] != starts[:-1] + 1))
        self.first, self.last = starts[new], starts[np.append(np.flatnonzero(new)[1:], len(starts)) - 1]
        self.at, self.row = chosen[new], row[self.first]
        self.keys = hashes[self.at]


def stretches(rows: list, size_of) -> Iterator[list]:
    out, size = [], 0
    for r in rows:
        if out and size + size_of(r) > STRETCH:
            yield out
            out, size = [], 0
        out.append(r)
        size += size_of(r)
    if out:
        yield out


def documents_of(b: pa.RecordBatch) -> list[tuple[int, bytes]]:
    return [(NO_ID if i is None else i, (t or "").encode("utf-8", "surrogatepass")) for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist())]


def parcels(kind: int, slot: np.ndarray, **columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One parcel for each slot, with the columns' values of that slot."""
    order = np.argsort(slot, kind="stable")
    slot = slot[order]
    columns = {k: v[order] for k, v in columns.items()}
    cuts = np.flatnonzero(np.diff(slot)) + 1
    for s, e in zip([0, *cuts], [*cuts, len(slot)]):
        if e > s:
            yield parcel(int(slot[s]), kind, None, *(packed(columns[k][s:e]) if k in columns else None for k in "xyz"))


def parcel(slot: int, kind: int, doc_id: int | None, x, y, z) -> pa.RecordBatch:
    return batch(PARCEL, [slot], [kind], [doc_id], [x], [y], [z])


def by_slot(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[dict]]]:
    rows = (r for b in batches for at in range(0, b.num_rows, 64) for r in b.slice(at, 64).to_pylist())
    return groupby(rows, lambda r: r["slot"])


class Dedup:
    """The steps over one table of documents."""

    def __init__(self, documents: DataFrame, length: int = LENGTH):
        self.rows, self.length = plain_ids(documents, "doc_id"), length
        self.anchor = min(ANCHOR, length)
        wanted = -(-(known_size(documents) or 0) // SLOT_BYTES)
        self.slots = min(max(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), wanted), SLOTS)

    def dealt(self, parcels_: DataFrame) -> DataFrame:
        """Parcels of a slot together, by kind; texts with one id one after the other, always in the same order."""
        return parcels_.repartition("slot").sortWithinPartitions("slot", "kind", "doc_id", "x")

    def texts(self) -> DataFrame:
        """Compressed texts, dealt by document."""
        slots = self.slots

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, 256):
                    rows = documents_of(b.slice(at, 256))
                    slot = doc_slot(np.array([i for i, _ in rows], np.int64), slots)
                    deflate = zstandard.ZstdCompressor(level=1).compress
                    none = [None] * len(rows)
                    yield batch(PARCEL, pa.array(slot), [TEXT] * len(rows), [i for i, _ in rows], [deflate(t) for _, t in rows], none, none)

        return self.rows.mapInArrow(run, PARCEL_DDL)

    def shared_anchors(self) -> DataFrame:
        """FINDINGS parcels (x: documents, y: anchor hashes), dealt by document, of anchors that two documents hold."""
        slots, length, anchor = self.slots, self.length, self.anchor

        def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, keys, size = [], [], 0
            for b in batches:
                for rows in stretches(documents_of(b), lambda r: len(r[1])):
                    found = Anchors([t for _, t in rows], length, anchor)
                    ids.append(np.array([i for i, _ in rows], np.int64)[found.row])
                    keys.append(found.keys)
                    size += len(found.keys)
                    if size > PACKED:
                        yield from deal(joined(ids, np.int64), joined(keys, np.uint64))
                        ids, keys, size = [], [], 0
            if size:
                yield from deal(joined(ids, np.int64), joined(keys, np.uint64))

        def deal(ids: np.ndarray, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
            # Five bytes of the hash within a slot: a chance match only sends a few strings on for nothing.
            yield from parcels(FINDINGS, key_slot(keys, slots), x=ids, y=keys.view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES])

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for slot, rows in by_slot(batches):
                got = list(rows)
                ids = joined([unpacked(r["x"], np.int64) for r in got], np.int64)
                short = joined([unpacked(r["y"], np.uint8) for r in got], np.uint8).reshape(-1, KEY_BYTES)
                keys = np.zeros((len(ids), 8), np.uint8)
                keys[:, :KEY_BYTES] = short
                keys = keys.view(np.uint64).ravel()
                order = np.lexsort((ids, keys))
                ids, keys = ids[order], keys[order]
                new_pair = np.append(True, (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1]))
                ids, keys = ids[new_pair], keys[new_pair]
                if not len(ids):
                    continue
                new = np.append(True, keys[1:] != keys[:-1])
                shared = np.repeat(np.diff(np.append(np.flatnonzero(new), len(keys))) > 1, np.diff(np.append(np.flatnonzero(new), len(keys))))
                ids, keys = ids[shared], keys[shared]
                yield from parcels(FINDINGS, doc_slot(ids, slots), x=ids, y=keys | (np.uint64(slot) << KEY_BITS))

        return self.dealt(self.rows.mapInArrow(post, PARCEL_DDL)).mapInArrow(meet, PARCEL_DDL)

    def strings(self) -> DataFrame:
        """FINDINGS parcels, dealt by anchor (x: documents, y: the other fields, z: the bytes), and RANGES parcels."""
        slots, length, anchor = self.slots, self.length, self.anchor

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for slot, rows in by_slot(batches):
                wanted, held = [], []
                for r in rows:
                    if r["kind"] == FINDINGS:
                        wanted.append(pair_hash(unpacked(r["x"], np.int64), unpacked(r["y"], np.uint64)))
                    elif wanted:
                        held.append((r["doc_id"], zstandard.ZstdDecompressor().decompress(r["x"])))
                if held:
                    yield from strings_of(slot, np.unique(joined(wanted, np.uint64)), held, slots, length, anchor)

        return self.dealt(self.shared_anchors().unionByName(self.texts())).mapInArrow(cut, PARCEL_DDL)

    def removed_ranges(self) -> DataFrame:
        """RANGES parcels (x: documents, y: starts, z: ends), dealt by document."""
        slots, length = self.slots, self.length

        def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, rows in by_slot(batches):
                records, data = [], []
                for r in rows:
                    if r["kind"] == RANGES:  # already dealt by document
                        yield parcel(r["slot"], RANGES, None, r["x"], r["y"], r["z"])
                        continue
                    records.append(Strings.read(r["x"], r["y"]))
                    data.append(unpacked(r["z"], np.uint8))
                if records:
                    docs, starts, ends = duplicated(Strings.merged(records), joined(data, np.uint8), length)
                    yield from parcels(RANGES, doc_slot(docs, slots), x=docs, y=starts, z=ends)

        return self.dealt(self.strings()).mapInArrow(sort, PARCEL_DDL)

    def result(self, with_kept: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, rows in by_slot(batches):
                parts, ranges, last, shift = [], None, None, 0
                for r in rows:
                    if r["kind"] == RANGES:
                        parts.append([unpacked(r[k], np.int64) for k in "xyz"])
                        continue
                    if ranges is None:
                        ranges = [joined([p[k] for p in parts], np.int64) for k in range(3)]
                        order = np.lexsort((ranges[1], ranges[0]))
                        ranges = [a[order] for a in ranges]
                    text = zstandard.ZstdDecompressor().decompress(r["x"])
                    shift = shift if r["doc_id"] == last else 0
                    s, e = np.searchsorted(ranges[0], r["doc_id"], "left"), np.searchsorted(ranges[0], r["doc_id"], "right")
                    s, e = s + np.searchsorted(ranges[1][s:e], (shift, shift + len(text)))
                    yield kept_row(r["doc_id"], text, ranges[1][s:e] - shift, ranges[2][s:e] - shift, with_kept)
                    last, shift = r["doc_id"], shift + len(text)

        return self.dealt(self.removed_ranges().unionByName(self.texts())).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


class Strings:
    """Runs of strings, a row each: the anchor's hash, the document, where the run starts in it, where the anchor
    starts in the run, and the run's bytes ``n``.  The bytes lie one run after the other in an array beside, or, where
    given, at ``place``."""

    FIELDS = {"keys": np.uint64, "starts": np.int64, "offsets": np.int16, "n": np.int16}

    def __init__(self, docs, keys, starts, offsets, n, place=None):
        self.docs, self.keys, self.starts, self.offsets, self.n = docs, keys, starts, offsets, n.astype(np.int64)
        self.place = np.cumsum(self.n) - self.n if place is None else place

    def __len__(self) -> int:
        return len(self.docs)

    def take(self, at: np.ndarray) -> Strings:
        return Strings(self.docs[at], self.keys[at], self.starts[at], self.offsets[at], self.n[at], self.place[at])

    def bytes_of(self, data: np.ndarray) -> np.ndarray:
        """The runs' bytes, one after the other."""
        return data[np.repeat(self.place - (np.cumsum(self.n) - self.n), self.n) + np.arange(self.n.sum())]

    def written(self) -> tuple[bytes, bytes]:
        """Field after field, so that each compresses; ``place`` is not written."""
        return packed(self.docs), zstandard.ZstdCompressor(level=1).compress(b"".join(getattr(self, k).astype(t).tobytes() for k, t in self.FIELDS.items()))

    @classmethod
    def read(cls, docs: bytes, rest: bytes) -> Strings:
        ids, raw, at, fields = unpacked(docs, np.int64), zstandard.ZstdDecompressor().decompress(rest), 0, {}
        for k, t in cls.FIELDS.items():
            size = len(ids) * np.dtype(t).itemsize
            fields[k], at = np.frombuffer(raw[at : at + size], t), at + size
        return cls(ids, **fields)

    @classmethod
    def merged(cls, parts: list[Strings]) -> Strings:
        return cls(np.concatenate([p.docs for p in parts]), **{k: np.concatenate([getattr(p, k) for p in parts]) for k in cls.FIELDS})


def pair_hash(ids: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return mix(ids.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25) ^ keys)


def shifts_of(rows) -> Iterator[int]:
    """Where each text (id, bytes) begins if the texts of an id stand one after the other: ranges are given so."""
    last, at = None, 0
    for i, text in rows:
        at = at if i == last else 0
        yield at
        last, at = i, at + len(text)


def strings_of(slot: int, wanted: np.ndarray, held: list[tuple[int, bytes]], slots: int, length: int, anchor: int) -> Iterator[pa.RecordBatch]:
    """The strings of the ``wanted`` (hashed) pairs of document and anchor in a slot's texts."""
    data, parts, alike, base = [], [], [], 0
    shifts = shifts_of(held)
    for rows in stretches([(i, t, next(shifts)) for i, t in held], lambda r: len(r[1])):
        found = Anchors([t for _, t, _ in rows], length, anchor)
        ids = np.array([i for i, _, _ in rows], np.int64)[found.row]
        shift = np.array([s for _, _, s in rows], np.int64) - found.begins
        keys = (found.keys & ((np.uint64(1) << KEY_BITS) - np.uint64(1))) | (key_slot(found.keys, slots).astype(np.uint64) << KEY_BITS)
        pairs = pair_hash(ids, keys)
        own = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, pairs), len(wanted) - 1)] == pairs)
        first = found.first[own]
        n, offsets = found.last[own] - first + length, found.at[own] - first
        alike.append(mix(between(found.prefix, first, first + n) ^ mix(n.astype(np.uint64) * np.uint64(64) + offsets.astype(np.uint64))))
        parts.append(Strings(ids[own], found.keys[own], first + shift[found.row[own]], offsets, n, base + first))
        data.append(found.data)
        base += len(found.data)
    data, alike, places = joined(data, np.uint8), joined(alike, np.uint64), joined([p.place for p in parts], np.int64)
    if not len(alike):
        return
    runs = Strings.merged(parts)
    runs.place = places
    # Runs alike in all bytes: the smallest id's go on; larger ids' are settled here.
    order = np.lexsort((runs.docs, alike))
    new = np.append(True, alike[order[1:]] != alike[order[:-1]])
    head = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    later = runs.docs[order] > runs.docs[head]
    a, b = order[later], head[later]
    later = runs.n[a] == runs.n[b]
    a, b = a[later], b[later]
    if len(a):
        n = runs.n[a]
        begin = np.cumsum(n) - n
        steps = np.arange(n.sum())
        same = np.logical_and.reduceat(data[np.repeat(runs.place[a] - begin, n) + steps] == data[np.repeat(runs.place[b] - begin, n) + steps], begin)
        out = runs.take(a[same])
        if len(out):
            yield parcel(slot, RANGES, None, packed(out.docs), packed(out.starts), packed(out.starts + out.n))
        rest = np.ones(len(runs), bool)
        rest[a[same]] = False
        runs = runs.take(np.flatnonzero(rest))
    to = key_slot(runs.keys, slots)
    order = np.argsort(to, kind="stable")
    runs, to = runs.take(order), to[order]
    cuts = np.flatnonzero(np.diff(to)) + 1
    for s, e in zip([0, *cuts], [*cuts, len(to)]):
        if e > s:
            part = runs.take(np.arange(s, e))
            yield parcel(int(to[s]), FINDINGS, None, *part.written(), packed(part.bytes_of(data)))


def grouped(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by the columns, and the ascending number of each group of equal rows in that order."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(max(len(order) - 1, 0), bool)
    for c in columns:
        new |= c[order[1:]] != c[order[:-1]]
    return order, np.cumsum(np.append(False, new))


def duplicated(runs: Strings, data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(documents, starts, ends) of ranges of strings that a smaller document holds too.

    Whole runs are sorted first: those equal to one of a smaller document go as they are, and one of each content is
    left.  Where an anchor still has several, their strings are sorted one by one.  Anchors are taken a few at a time.
    """
    order = np.argsort(runs.keys, kind="stable")
    runs = runs.take(order)
    strings = np.cumsum(runs.n - length + 1)
    new = np.flatnonzero(np.append(True, runs.keys[1:] != runs.keys[:-1]))
    out, begin = [], 0
    while begin < len(runs):
        done = strings[begin - 1] if begin else 0
        k = np.searchsorted(new, max(np.searchsorted(strings, done + SORTED), begin + 1))
        end = int(new[k]) if k < len(new) else len(runs)
        out += duplicated_part(runs.take(np.arange(begin, end)), data, length)
        begin = end
    return tuple(joined([o[k] for o in out], np.int64) for k in range(3))


def duplicated_part(runs: Strings, data: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    order, group = grouped(runs.keys, runs.offsets, runs.n)
    runs = runs.take(order)
    own = runs.bytes_of(data)
    at = np.cumsum(runs.n) - runs.n
    content = equal_runs(Comparer(own, at, runs.n), group)
    least = np.full(int(content.max()) + 1, NO_ID)
    np.minimum.at(least, content, runs.docs)
    settled = runs.docs > least[content]
    yield runs.docs[settled], runs.starts[settled], (runs.starts + runs.n)[settled]
    # One run of each content is left for each anchor that has several.
    one = np.flatnonzero(~settled)
    _, several, times = np.unique(runs.keys[one], return_inverse=True, return_counts=True)
    one = one[times[several] > 1]
    if len(one):
        yield single_strings(runs.take(one), own, at[one], length)


def single_strings(runs: Strings, data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    per = runs.n - length + 1
    run = np.repeat(np.arange(len(runs)), per)
    shift = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    # Strings can only be equal if the anchor and its place in them are.
    order, group = grouped(runs.keys[run], runs.offsets[run] - shift)
    content = np.empty(len(order), np.int64)
    content[order] = equal_runs(Comparer(data, (at[run] + shift)[order], np.full(len(order), length)), group)
    docs = runs.docs[run]
    least = np.full(int(content.max()) + 1, NO_ID)
    np.minimum.at(least, content, docs)
    hit = np.flatnonzero(docs > least[content])
    # Neighbouring strings of a run make one range.
    new = np.append(True, (run[hit[1:]] != run[hit[:-1]]) | (hit[1:] != hit[:-1] + 1))[: len(hit)]
    first, last = hit[new], hit[np.append(np.flatnonzero(new)[1:], len(hit))[: new.sum()] - 1]
    base = runs.starts[run[first]]
    return docs[first], base + shift[first], base + shift[last] + length


def kept_row(doc_id: int, text: bytes, starts: np.ndarray, ends: np.ndarray, with_kept: bool) -> pa.RecordBatch:
    """The result of a text without the ranges (sorted by start)."""
    kept, n_removed, n_spans = text, 0, 0
    if len(starts):
        reach = np.maximum.accumulate(ends)
        new = np.append(True, starts[1:] > reach[:-1])
        begin, stop = starts[new], reach[np.append(np.flatnonzero(new)[1:], len(starts)) - 1]
        n_removed, n_spans = int((stop - begin).sum()), len(begin)
        kept = b"".join(text[a:b] for a, b in zip([0, *stop.tolist()], [*begin.tolist(), len(text)]))
    return batch(RESULT, [None if doc_id == NO_ID else doc_id], [len(text)], [n_removed], [n_spans], [hashlib.sha256(kept).hexdigest()], [kept if with_kept else None])


def substring_dedup(documents: DataFrame, length: int = LENGTH, with_kept: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and, if asked for, the kept bytes of
    every row of ``documents``."""
    out = Dedup(documents, length).result(with_kept)
    return out if with_kept else out.drop("kept")
