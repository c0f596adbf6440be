"""Conversations rendered through a compiled template, and read back.

Rows of a conversation go by turn, rows of one turn by role and text.  Null texts and roles count as empty; rows
without conv_id form one conversation with a null id.  A conversation's digests run over its turns in order, so its
rows meet in one task, but as a sorted stream: no conversation is ever held whole, however long it is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chat_template import DEFAULT_TEMPLATE, compile_template, read_turns
from .common import batch

FORMATTED = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("learnt", pa.list_(pa.list_(pa.int32())))])
DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def in_order(conversations: DataFrame) -> DataFrame:
    """Rows of each conversation together and in order."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[dict]]]:
    rows = (r for b in batches for at in range(0, b.num_rows, 512) for r in b.slice(at, 512).to_pylist())
    return groupby(rows, lambda r: r["conv_id"])


def encoded(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def chat_format(conversations: DataFrame, template: str = DEFAULT_TEMPLATE) -> DataFrame:
    """conv_id, formatted text and learnt spans [start, end) of each conversation (whose text must fit in a row)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)
        for conv_id, rows in streamed(batches):
            parts, spans, n = [], [], 0
            for text, learnt in render({"messages": rows}):
                if learnt and text:
                    if spans and spans[-1][1] == n:
                        spans[-1][1] = n + len(text)
                    else:
                        spans.append([n, n + len(text)])
                parts.append(text)
                n += len(text)
            yield batch(FORMATTED, [conv_id], ["".join(parts)], [spans])

    return in_order(conversations).mapInArrow(run, "conv_id long, formatted string, learnt array<array<int>>")


def chat_digests(conversations: DataFrame, template: str = DEFAULT_TEMPLATE) -> DataFrame:
    """What the formatted output of each conversation says when read back: number and digest of its turns, length
    and digest of the text under the loss mask, and its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render, out = compile_template(template), []
        for conv_id, rows in streamed(batches):
            turns, loss, seen = hashlib.sha256(), hashlib.sha256(), [0, 0]

            def on_turn(role: str, text: str, turns=turns, seen=seen) -> None:
                turns.update(encoded(f"{role}\n{text}\n"))
                seen[0] += 1

            def on_learnt(text: str, loss=loss, seen=seen) -> None:
                loss.update(encoded(text))
                seen[1] += len(text)

            n = read_turns(render({"messages": rows}), on_turn, on_learnt)
            out.append((conv_id, seen[0], turns.hexdigest(), seen[1], loss.hexdigest(), n))
            if len(out) >= 1000:
                yield batch(DIGESTS, *map(list, zip(*out)))
                out = []
        if out:
            yield batch(DIGESTS, *map(list, zip(*out)))

    return in_order(conversations).mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
