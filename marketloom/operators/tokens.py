"""Token windows for training, as arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IGNORED = -100


def keep_last(ids: Column, n: int) -> Column:
    return F.when(F.size(ids) > n, F.slice(ids, -n, n)).otherwise(ids)


def training_window(prompt: Column, response: Column, max_length: int) -> Column:
    """input_ids, attention_mask and labels: the response cut to max_length - 1, the prompt's end fills the rest."""
    most = max(int(max_length), 8)
    answer = F.slice(response, 1, most - 1)
    room = F.greatest(F.lit(1), F.lit(most) - F.size(answer))
    start = F.greatest(F.lit(1), F.size(prompt) - room + 1)
    question = F.slice(prompt, start, room)
    ids = F.concat(question, answer)
    ignored = F.transform(question, lambda _: F.lit(IGNORED))
    return F.struct(ids.alias("input_ids"), F.transform(ids, lambda _: F.lit(1)).alias("attention_mask"), F.concat(ignored, answer).alias("labels"))


def templated(df: DataFrame, render: Callable[[str], str], encode: Callable[[str], list[int]], decode: Callable[[list[int]], str], most: int, column: str = "prompt") -> DataFrame:
    """``df`` with ``column`` put through a chat template (``render`` takes the stripped text) and, where that has more
    than ``most`` tokens, cut to the last of them."""

    def run(batches):
        for part in batches:
            shown = [render((text or "").strip()) for text in part[column]]
            ids = [encode(text) for text in shown]
            yield part.assign(**{column: [decode(i[-most:]) if len(i) > most else text for i, text in zip(ids, shown)]})

    return df.mapInPandas(run, df.schema)


def padded(ids: Column, length: Column, value: int) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(value), F.greatest(F.lit(0), length - F.size(ids))))
