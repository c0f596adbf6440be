"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of input a core up to which a table is dealt anew, and statistics that stand for plans of unknown size.
SMALL_PART, UNKNOWN_SIZE = 4_000_000, 1 << 60


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's spark.checkpoint.dir; only on one machine (tests), where it is unset, set a folder of our own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        wanted = spark.conf.get("spark.checkpoint.dir", None)
        if not wanted and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(wanted or os.path.join(tempfile.gettempdir(), f"marketloom-{uuid.uuid4().hex}"))


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def texts(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """Python strings of an Arrow column; null becomes the empty text."""
    return [x or "" for x in column.to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in smaller parts, so that few texts are Python objects at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def give_back() -> None:
    """Return unused memory of this process to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` for mapInArrow, in a worker that Spark keeps for later tasks: at a task's end its memory is given back."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(columns, schema)], schema=schema)


def known_size(df: DataFrame) -> int | None:
    """Bytes that ``df`` reads, by its plan's statistics; None if they don't know."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < UNKNOWN_SIZE else None


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores, if it is so small, and of so few files, that scans may leave cores idle."""
    cores, size = df.sparkSession.sparkContext.defaultParallelism, known_size(df)
    return df.repartition(cores) if size is not None and size <= SMALL_PART * cores and 0 < len(df.inputFiles()) < cores else df


def crc_bucket(column: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)


def plain_ids(df: DataFrame, name: str) -> DataFrame:
    """Only the id and text columns of an input, whatever else it carries, over all cores."""
    return spread(df.select(F.col(name).cast("long").alias(name), F.col("text").cast("string").alias("text")))
