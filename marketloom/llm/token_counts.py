"""Token counts by rank-synchronous merging of ragged arrays.

The pre-tokens that a batch of texts needs and the worker has not met are laid out as one flat symbol array with
row starts.  Every round looks up the rank of each neighbouring pair, finds each row's lowest rank, applies that
pair at all its places in the row at once (left to right where places overlap), and drops finished rows.  The
symbols that survive are counted.

A long row (a line without blanks of thousands of letters) has as many rounds as different ranks, so it isn't looked
through each round: its places are kept by rank, and a round touches the places of the lowest rank and their neighbours
only.  All its work is in proportion to its merges, whatever its length.

Null and empty texts have no tokens.  Repeated rows are counted alike.  Nothing is truncated.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import bpe_files
from .common import batch, plain_ids, slices, texts

#: Entries of a worker's memory of pieces, and characters of them; it starts afresh beyond, so memory stays bounded.
MEMORY, MEMORY_CHARS = 200_000, 4_000_000
SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])


#: Symbols from which on a row's places are kept by rank.
LONG = 1_000


class RankTable:
    """Sorted pair keys with ranks and results, for array look-ups."""

    def __init__(self, vocabulary: bpe_files.Vocabulary):
        self.width = np.int64(max(vocabulary.strings) + 1)
        keys = np.array([a * int(self.width) + b for a, b in vocabulary.merges], np.int64)
        order = np.argsort(keys)
        ranks, made = np.array(list(vocabulary.merges.values()), np.int64).reshape(-1, 2).T
        self.keys, self.ranks, self.made = keys[order], ranks[order], made[order]
        self.none = np.int64(len(keys))

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks (``none`` where a pair has no merge) and places in the table."""
        wanted = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], self.none), at


def surviving(rows: list[list[int]], table: RankTable) -> np.ndarray:
    """Number of symbols left in each row once no merge applies.  Rows are not empty."""
    lengths = np.array([len(r) for r in rows], np.int64)
    counts, owner = lengths.copy(), np.arange(len(rows))
    flat = np.fromiter((s for r in rows for s in r), np.int64, int(lengths.sum()))
    while len(flat):
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        row = np.repeat(np.arange(len(lengths)), lengths)
        rank, at = table.look_up(flat, np.append(flat[1:], 0))
        rank[starts + lengths - 1] = table.none  # a row's last symbol has no right neighbour
        lowest = np.minimum.reduceat(rank, starts)
        counts[owner] = lengths
        here = (rank == lowest[row]) & (rank < table.none)
        # In a run of overlapping places every second one, from the left, is merged.
        index = np.arange(len(flat))
        run_start = np.maximum.accumulate(np.where(here & ~np.append(False, here[:-1]), index, 0))
        here &= (index - run_start) % 2 == 0
        flat[here] = table.made[at[here]]
        keep = ~np.append(False, here[:-1])
        lengths = lengths - np.bincount(row[here], minlength=len(lengths))
        alive = (lowest < table.none) & (lengths > 1)
        counts[owner] = lengths
        keep &= alive[row]
        flat, owner, lengths = flat[keep], owner[alive], lengths[alive]
    return counts


def surviving_long(symbols: list[int], table: RankTable) -> int:
    """Number of symbols left in one row, as ``surviving`` counts them."""
    flat = np.array(symbols, np.int64)
    n = len(flat)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)  # the symbols still there, linked
    rank = np.full(n + 1, table.none)  # of the pair that begins at a place; ``none`` beyond the last
    made = np.zeros(n + 1, np.int64)
    waiting: dict[int, list[np.ndarray]] = {}
    ranks: list[int] = []

    def pair(at: np.ndarray) -> None:
        """Look up the pairs at these places (sorted) and keep the places by rank."""
        right = after[at]
        found, where = table.look_up(flat[at], flat[np.minimum(right, n - 1)])
        rank[at], made[at] = np.where(right < n, found, table.none), table.made[where]
        at = at[rank[at] < table.none]
        order = np.argsort(rank[at], kind="stable")
        at = at[order]
        cuts = np.flatnonzero(np.diff(rank[at])) + 1
        for s, e in zip([0, *cuts], [*cuts, len(at)]):
            if e > s:
                r = int(rank[at[s]])
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(ranks, r)
                waiting[r].append(at[s:e])

    pair(np.arange(n - 1))
    left = n
    while ranks:
        lowest = heapq.heappop(ranks)
        here = np.unique(np.concatenate(waiting.pop(lowest)))
        here = here[rank[here] == lowest]  # some have changed since
        if not len(here):
            continue
        # Of places that overlap every second one, from the left, is merged.
        index = np.arange(len(here))
        chained = np.append(False, after[here[:-1]] == here[1:])
        here = here[(index - np.maximum.accumulate(np.where(chained, 0, index))) % 2 == 0]
        gone = after[here]
        flat[here], rank[gone] = made[here], table.none
        after[here] = after[gone]
        inside = after[here] < n
        before[after[here][inside]] = here[inside]
        left -= len(here)
        changed = np.concatenate([here, before[here][before[here] >= 0]])
        pair(np.unique(changed))
    return left


class PieceCounts(dict):
    """Token counts of pieces without white space, filled a batch at a time."""

    def __init__(self, path: str):
        super().__init__()
        self.chars = 0
        self.vocabulary = bpe_files.vocabulary(path)
        self.table = RankTable(self.vocabulary)

    def learn(self, pieces: Iterable[str]) -> None:
        new = [p for p in pieces if p not in self]
        split = [self.vocabulary.pre_tokens(p) for p in new]
        words = list({w for s in split for w in s if isinstance(w, str)})
        rows = {w: self.vocabulary.symbols(w) for w in words}
        short = {w: r for w, r in rows.items() if len(r) < LONG}
        counted = dict(zip(short, surviving(list(short.values()), self.table).tolist())) if short else {}
        counted |= {w: surviving_long(r, self.table) for w, r in rows.items() if w not in short}
        for piece, parts in zip(new, split):
            self.chars += len(piece)
            self[piece] = sum(counted[w] if isinstance(w, str) else 1 for w in parts)


def token_counts(df: DataFrame, path: str | None = None, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every row of ``df``."""
    path = path or bpe_files.default_path()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = PieceCounts(path)
        for b in slices(batches):
            rows = texts(b.column("text"))
            n_tokens = []
            for at in range(0, len(rows), 256):
                if len(known) > MEMORY or known.chars > MEMORY_CHARS:
                    known.clear()
                    known.chars = 0
                cut = [bpe_files.chunks(t) for t in rows[at : at + 256]]
                known.learn({p for pieces in cut for p in pieces})
                n_tokens += [sum(map(known.__getitem__, pieces)) for pieces in cut]
            n_bytes = [len(t.encode("utf-8", "surrogatepass")) for t in rows]
            yield batch(SCHEMA, b.column("doc_id"), n_bytes, n_tokens, [n > limit for n in n_tokens])

    return plain_ids(df, "doc_id").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
