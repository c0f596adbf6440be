"""Runs of periodic words, from the Lyndon arrays of both orders of an ordered alphabet.

Words are numbered by a document's own order of them.  For an order, the longest Lyndon word at i ends before the next
suffix that is smaller (``nss``).  Every run of period q and length 2 q or more holds such a word of length q under one of
the two orders, whose next smaller suffix is q words on; so the runs are read off the pairs (i, nss[i]) and how far the
two suffixes agree.

One pass from left to right finds ``nss`` and the previous smaller suffix ``pss`` of each i by comparing neighbours on the
chain i - 1, pss[i - 1], ...; how far the two of a compared pair agree is kept, and is reused in two ways:

* A smaller suffix j of the chain agrees with its child b for ``plce[b]`` words, and b with i for l words.  Where the two
  numbers differ, the lesser is how far j and i agree, and which of them is smaller is known.
* The match that reaches furthest, ``[start, end)`` with the same words ``shift`` before, holds the pair (j, i) if it holds
  both, so it agrees as far as (j - shift, i - shift) did, up to ``end``.

Words are compared only beyond ``end``, which never goes back: the pass is linear in the number of words, without suffix
structures or fingerprints.  The left end of a run is found by stepping back from its first pair, under a period.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, slices, spread, tidy

#: A run is at least so many words, and periods, long.
WORDS, TIMES = 6, 4
RUNS = pa.schema([("doc_id", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])
RUNS_DDL = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def lyndon(a: list[int]) -> tuple[list[int], list[int]]:
    """For each i the start of the next smaller suffix (the length, if none), and how many words the two suffixes share.

    ``a`` ends with a value smaller than all others.
    """
    n = len(a) - 1
    nss, nlce = [n] * n, [0] * n
    pss, plce = [-1] * n, [0] * n  # previous smaller suffix; words shared with it
    start, end, shift = 0, 0, 0
    for i in range(1, n):
        j = i - 1
        if i >= end:
            x, y = a[j], a[i]
            if x != y:
                same = 0
                if x < y:
                    pss[i] = j
                    continue
            else:
                same = 1
                while a[j + same] == a[i + same]:
                    same += 1
                start, end, shift = i, i + same, 1
        else:
            k = i - shift
            same = nlce[k - 1] if nss[k - 1] == k else plce[k]
            if i + same >= end:
                same = end - i
                while a[j + same] == a[i + same]:
                    same += 1
                start, end, shift = i, i + same, 1
        while True:
            # Here j and i share ``same`` words, no more.
            if a[j + same] < a[i + same]:
                pss[i], plce[i] = j, same
                break
            nss[j], nlce[j] = i, same
            shared = plce[j]
            j = pss[j]
            if j < 0:
                break
            if shared < same:  # i goes on as the child did, which was larger than j
                pss[i], plce[i] = j, shared
                break
            if shared == same:
                if i + same < end and j >= start:
                    k, m = i - shift, j - shift
                    same = nlce[m] if nss[m] == k else plce[k] if pss[k] == m else same
                    if i + same < end:
                        continue
                    same = end - i
                while a[j + same] == a[i + same]:
                    same += 1
                if i + same > end:
                    start, end, shift = i, i + same, i - j
    return nss, nlce


def runs(words: list, least: int = WORDS, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of every maximal stretch with a smallest period that it holds ``times`` (2 or more) times
    and that is ``least`` words long, by start, then period."""
    n = len(words)
    if n < max(least, times):
        return []
    number = {w: k for k, w in enumerate(sorted(set(words)))}
    up = [number[w] for w in words]
    if (len(number) - 1) + min(least, times) > n:  # too many different words for any to be there so often
        return []
    found: dict[tuple[int, int], int] = {}
    for a in (up, [len(number) - 1 - x for x in up]):
        a.append(-1)
        nss, nlce = lyndon(a)
        for i in range(n):
            # The first such pair of a run is within its first period, so the two suffixes share the others but one.
            if nlce[i] and nlce[i] >= (times - 2) * (nss[i] - i):
                q = nss[i] - i
                key = nss[i] + nlce[i], q
                if key not in found or found[key] > i:
                    found[key] = i
        a.pop()
    out = []
    for (end, q), i in found.items():
        while i and up[i - 1] == up[i - 1 + q]:
            i -= 1
        if end - i >= max(least, times * q):
            out.append((i, end - i, q))
    return sorted(out)


def collapsed(words: list, found: list[tuple[int, int, int]]) -> list:
    """The words without those that a run holds after its first period."""
    if not found:
        return words
    out, at = [], 0
    for start, stop in sorted((s + q, s + length) for s, length, q in found):
        if start > at:
            out += words[at:start]
        at = max(at, stop)
    return out + words[at:]


def most_repeated(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest length by period, exactly; of several the one of smallest start, then period."""
    best = None
    for run in found:  # by start, then period
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def periodic(doc_id: int | None, words: list) -> list:
    """Make the tail of every tenth document (by crc32 of its id) periodic."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * -(-(n - a) // p))[: n - a]


def periodic_runs(documents: DataFrame, prepare: Callable[[int | None, list], list] | None = None, least: int = WORDS, times: int = TIMES) -> DataFrame:
    """Of every row of ``documents`` (doc_id, text): doc_id, n_runs, the most repeated run (start, length, period and
    exponent_milli, the length in thousandths of periods; null without a run), and digests of the list of runs and of the
    text without repetitions.

    Words are what stands between blanks (space, tab to carriage return).  ``prepare`` may change a document's words
    beforehand.  Null, empty and blank texts have no words, so no runs.  Repeated rows and null ids are rows like any
    other; extra columns are not used.  A document is one task's work, linear in its words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 100):
            rows = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary())):
                words = (text.as_py() or b"").split()
                if prepare:
                    words = prepare(doc_id, words)
                found = runs(words, least, times)
                top = most_repeated(found)
                listed = hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in found).encode()).hexdigest()
                kept = hashlib.sha256(b" ".join(collapsed(words, found))).hexdigest()
                rows.append((doc_id, len(found), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None, listed, kept))
            yield batch(RUNS, *zip(*rows)) if rows else batch(RUNS, *([] for _ in RUNS))

    ids_and_texts = spread(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    return ids_and_texts.mapInArrow(tidy(run), RUNS_DDL)
