"""Where rows from the outside come in: fetchers are plain callables, so tests and users bring their own.

A fetcher takes a request (a row as dict) and returns result rows as dicts.  Each task calls its fetcher for its rows,
with retries; nothing here opens a connection by itself.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Fetcher = Callable[[dict], list[dict]]
FETCHERS: dict[str, Fetcher] = {}

#: What is searched for a company.
SEARCHES = ("{name} 股票 最新消息", "{name} 股价 异动", "{name} 公告", "{name} 财报 业绩", "{name} 研报", "{symbol} {name}")


class Throttled(Exception):
    """Raised by a fetcher that was asked to slow down."""


def register(name: str, fetcher: Fetcher) -> None:
    FETCHERS[name] = fetcher


def with_retries(call: Callable[[], list[dict]], attempts: int = 3, base: float = 3.0, extra: float = 20.0, sleep: Callable[[float], None] = time.sleep) -> list[dict]:
    """``call``'s result; failures are repeated after base * 2**k seconds, longer when throttled."""
    for k in range(attempts):
        try:
            return call()
        except Exception as error:
            if k + 1 == attempts:
                raise
            sleep(base * 2**k + (extra if isinstance(error, Throttled) else 0))
    return []


def fetch(requests: DataFrame, fetcher: Fetcher, schema: str, attempts: int = 3, base: float = 3.0) -> DataFrame:
    """Result rows of a fetcher for each request."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for request in part.to_dict("records"):
                if rows := with_retries(lambda r=request: fetcher(r), attempts, base):
                    yield pd.DataFrame(rows)

    return requests.mapInPandas(run, schema)


def searches(companies: DataFrame) -> DataFrame:
    """The search requests (symbol, query, position) of each company (symbol, name)."""

    def filled_in(text: str):
        return F.replace(F.replace(F.lit(text), F.lit("{name}"), F.col("name")), F.lit("{symbol}"), F.col("symbol"))

    return companies.select("symbol", F.posexplode(F.array(*map(filled_in, SEARCHES))).alias("position", "query")).select("symbol", "query", "position")


def cached_or_fetched(wanted: DataFrame, cache: DataFrame, key: str, fetcher: Fetcher, schema: str) -> DataFrame:
    """A row of ``cache`` for each key of ``wanted`` that it has, and what the fetcher finds for the others."""
    keys = wanted.dropDuplicates([key])
    found = fetch(keys.join(cache.select(key), key, "left_anti"), fetcher, schema)
    return cache.join(keys.select(key), key, "left_semi").select(found.columns).unionByName(found)


def generate(prompts: DataFrame, client: Callable[[list[str]], list[str]], column: str = "prompt", batch_size: int = 64) -> DataFrame:
    """``prompts`` with raw_output from a text model; ``client`` takes and returns lists of texts.

    ``client`` is called in each task with at most ``batch_size`` prompts, and is an error if it returns another number of
    answers.  It is the caller's, as are its settings (model, adapter, sampling): a closure over them, pickled by value.
    """
    fields = ", ".join(f"`{n}` {t}" for n, t in prompts.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for at in range(0, len(part), batch_size):
                own = part.iloc[at : at + batch_size].copy()
                answers = list(client(own[column].tolist()))
                if len(answers) != len(own):
                    raise ValueError(f"{len(own)} prompts, but {len(answers)} answers")
                own["raw_output"] = answers
                yield own

    return prompts.mapInPandas(run, f"{fields}, raw_output string")


def offline_client(texts: list[str]) -> list[str]:
    """Stands in for a model: names a direction by the prompt's length."""
    return [f"{'涨' if len(t) % 2 else '跌'}" for t in texts]
