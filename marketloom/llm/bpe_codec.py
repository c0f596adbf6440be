"""BPE encoding and decoding.

A pre-token's symbols form a doubly linked list.  A priority queue holds (rank, place) of neighbouring pairs; the
lowest is taken, entries whose pair has changed since are skipped as stale, and a merge queues its two new pairs.
Decoding concatenates the vocabulary's strings, joined as the vocabulary's file asks (no decoder: by a space).

Null and empty texts have no ids and decode to the empty text.  Repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame

from . import bpe_files
from .common import batch, plain_ids, slices, texts, tidy

#: Entries, and characters of their keys, of each of the two generations of a worker's memory; longer keys aren't held.
MEMORY, MEMORY_CHARS, LONG_KEY = 160_000, 3_000_000, 1_000
IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
DECODED = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def merged(symbols: list[int], table: bpe_files.Merges) -> list[int]:
    """Ids of one pre-token, from its symbols.  The queue's entries are numbers: rank, then place in the low bits."""
    n = len(symbols)
    if n < 2:
        return symbols
    follow, mades = table
    shift = n.bit_length()
    mask = (1 << shift) - 1
    #: By place, the rank of the pair that begins there: a queued entry of another rank is stale.
    now = [follow[a].get(b, -1) for a, b in pairwise(symbols)]
    queue = [rank << shift | i for i, rank in enumerate(now) if rank >= 0]
    if not queue:
        return symbols
    heapify(queue)
    now.append(-1)
    symbols, before, after = list(symbols), list(range(-1, n - 1)), list(range(1, n + 1))
    while queue:
        at = heappop(queue)
        i, rank = at & mask, at >> shift
        if now[i] != rank:
            continue
        j = after[i]
        symbols[i] = made = mades[rank]
        symbols[j] = now[j] = now[i] = -1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            ranks, right = follow[made], symbols[k]
            if right in ranks:
                now[i] = rank = ranks[right]
                heappush(queue, rank << shift | i)
        h = before[i]
        if h >= 0:
            ranks = follow[symbols[h]]
            if made in ranks:
                now[h] = rank = ranks[made]
                heappush(queue, rank << shift | h)
            else:
                now[h] = -1
    return [s for s in symbols if s >= 0]


class Memory(dict):
    """Values by key, made when first asked for.  What neither of the last two generations asked for is forgotten."""

    def __init__(self, make=None):
        super().__init__()
        self.old, self.chars = {}, 0
        if make:
            self.make = make

    def __missing__(self, key: str):
        if len(key) > LONG_KEY:
            return self.make(key)
        if len(self) >= MEMORY or self.chars >= MEMORY_CHARS:
            self.old, self.chars = dict(self), 0
            self.clear()
        self.chars += len(key)
        out = self.old.get(key)
        if out is None:
            out = self.make(key)
        self[key] = out
        return out


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str | None = None):
        self.vocabulary = vocabulary = bpe_files.vocabulary(path or bpe_files.default_path())
        # The function doesn't hold the codec: without a cycle the memory goes with the task.
        self.words = Memory(lambda w: tuple(merged(vocabulary.symbols(w), vocabulary.table)))

    def word(self, word: str) -> tuple[int, ...]:
        return self.words[word]

    def piece(self, piece: str) -> list[int]:
        """Ids of a piece of text without white space."""
        out: list[int] = []
        for part in self.vocabulary.pre_tokens(piece):
            out += [part] if isinstance(part, int) else self.word(part)
        return out

    def encode(self, text: str) -> list[int]:
        return [i for p in bpe_files.chunks(text) for i in self.piece(p)]

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.vocabulary.strings[i] for i in ids])


class Shown(Memory):
    """By piece without white space, in normal form: its ids as decimals and the text decoded from them, each token after a space."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec, self.vocabulary = codec, codec.vocabulary
        self.ids, self.strings = {i: f" {i}" for i in self.vocabulary.strings}, {i: f" {s}" for i, s in self.vocabulary.strings.items()}

    def make(self, piece: str) -> tuple[str, str]:
        if not (piece.isascii() and piece.isalpha()) and (parts := self.vocabulary.split.findall(piece)) != [piece]:
            return joined([self[p] for p in parts])
        return self.tokens(merged(self.vocabulary.symbols(piece), self.vocabulary.table))

    def tokens(self, ids: list[int]) -> tuple[str, str]:
        return "".join([self.ids[i] for i in ids]), "".join([self.strings[i] for i in ids])

    def text(self, text: str) -> tuple[str, str]:
        if self.vocabulary.has_special(text):
            return self.tokens(self.codec.encode(text))
        # Normal forms don't depend on what stands beyond white space: the whole text is brought into its own at once.
        return joined([self[p] for p in bpe_files.chunks(bpe_files.normal(text))])


def joined(parts: list[tuple[str, str]]) -> tuple[str, str]:
    return "".join([p[0] for p in parts]), "".join([p[1] for p in parts])


def encode(df: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids (array of int) of every row of ``df``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path)
        for b in batches:
            for at in range(0, b.num_rows, 64):  # ids take more room than text: small batches
                part = b.slice(at, 64)
                yield batch(IDS, part.column("doc_id"), [codec.encode(t) for t in texts(part.column("text"))])

    return plain_ids(df, "doc_id").mapInArrow(tidy(run), "doc_id long, ids array<int>")


def decode(df: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of every row (doc_id, ids) of ``df``; null ids decode to the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path)
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                yield batch(DECODED, part.column("doc_id"), [codec.decode(x or []) for x in part.column("ids").to_pylist()])

    return df.select("doc_id", "ids").mapInArrow(tidy(run), "doc_id long, text string")


def round_trip_digests(df: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids and of the text decoded from them, for every row of ``df``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shown = Shown(Codec(path))
        for b in slices(batches):
            out = []
            for text in texts(b.column("text")):
                ids, back = shown.text(text)
                out.append((ids.count(" "), hashlib.sha256(ids[1:].encode()).hexdigest(), hashlib.sha256(back[1:].encode()).hexdigest()))
            yield batch(DIGESTS, b.column("doc_id"), *([r[k] for r in out] for k in range(3)))

    return plain_ids(df, "doc_id").mapInArrow(tidy(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
