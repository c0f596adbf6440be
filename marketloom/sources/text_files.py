"""A sink of text files with names of their own, committed as a whole.

    files.write.format("marketloom_files").mode("append").save(folder)      (path, value): a row a file

Each write is a layer: a folder that tasks fill, named by a version (see ``versions``) once all of them have ended.  A task
writes a file under a hidden name and renames it, so one that is killed leaves nothing to read, and its second attempt
writes the same.  At its end it lists its files' paths.  A write that fails is removed; what its last tasks or a
driver that dies leave is named by no version, so it is never read.
A file of a later layer replaces one of the same path; ``overwrite`` begins anew.

``read`` finds the newest file of each path by the lists alone: the driver lists no files, replaced ones aren't opened,
and texts aren't shuffled.  Files are dealt over tasks by number, whatever their size.

Tasks and commits read and write files through Arrow's file systems, by the folder's address (hdfs, s3, gs, abfs, or a
path that all machines share); the lists are read with Spark.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StringType, StructField, StructType

from .versions import Conflict, Files, Table, Version

NAME, SCHEMA = "marketloom_files", StructType([StructField("path", StringType()), StructField("value", StringType())])
#: Tasks a core that read files, and characters and files of a batch of theirs.
READERS, CHARS, FILES = 4, 4_000_000, 1_000


@dataclass
class Written(WriterCommitMessage):
    n_files: int


def lists(layer: str) -> str:
    """The folder that lists a layer's files."""
    return "l-" + layer[2:]


def opened(address: str):
    """The file system of an address, and the path in it."""
    from pyarrow import fs

    if address.startswith("file:/") and not address.startswith("file:///"):
        address = "file:///" + address.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(address)


class FilesWriter(DataSourceWriter):
    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite, self.layer = folder.rstrip("/"), overwrite, f"d-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Written:
        fs, root = opened(f"{self.folder}/{self.layer}")
        fs.create_dir(root, recursive=True)
        names, known = [], set()
        for row in iterator:
            target = posixpath.normpath(posixpath.join(root, row["path"] or "."))
            if not target.startswith(root + "/"):
                raise ValueError(f"{row['path']} leaves {self.folder}")
            parent, name = posixpath.split(target)
            if parent not in known:
                fs.create_dir(parent, recursive=True)
                known.add(parent)
            staged = posixpath.join(parent, f".{name}-{uuid.uuid4().hex}")
            with fs.open_output_stream(staged, compression=None) as out:
                out.write((row["value"] or "").encode())
            fs.move(staged, target)
            names.append(target.removeprefix(root + "/"))
        if names:
            fs, root = opened(f"{self.folder}/{lists(self.layer)}")
            fs.create_dir(root, recursive=True)
            staged = f"{root}/.{uuid.uuid4().hex}"
            with fs.open_output_stream(staged, compression=None) as out:
                for name in names:
                    out.write((json.dumps({"path": name}) + "\n").encode())
            fs.move(staged, staged.replace("/.", "/part-"))
        return Written(len(names))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow import fs as arrow

        fs, root = opened(f"{self.folder}/_versions")
        fs.create_dir(root, recursive=True)
        known = sorted(x.base_name for x in fs.get_file_info(arrow.FileSelector(root)) if x.base_name.endswith(".json") and not x.base_name.startswith("."))
        number, parts = 1, {}
        if known:
            number = int(known[-1][:-5]) + 1
            with fs.open_input_stream(f"{root}/{known[-1]}") as old:
                parts = {} if self.overwrite else json.loads(old.read())["parts"]
        parts[f"{number:012}"] = self.layer
        target, staged = f"{root}/{number:012}.json", f"{root}/.{self.layer}"
        with fs.open_output_stream(staged, compression=None) as out:
            out.write(Version(number, parts, SCHEMA.json()).text().encode())
        if fs.get_file_info(target).type != arrow.FileType.NotFound:
            fs.delete_file(staged)
            raise Conflict(f"version {number} of {self.folder} was committed by another writer")
        fs.move(staged, target)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow import fs as arrow

        for name in (self.layer, lists(self.layer)):
            fs, root = opened(f"{self.folder}/{name}")
            if fs.get_file_info(root).type != arrow.FileType.NotFound:
                fs.delete_dir(root)


class FilesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> StructType:
        return SCHEMA

    def writer(self, schema: StructType, overwrite: bool) -> FilesWriter:
        return FilesWriter(self.options["path"], overwrite)


def write(files: DataFrame, folder: str, mode: str = "append") -> None:
    """Write (path, value) as text files under ``folder``, all of them or none.  Of rows with one path one is kept."""
    spark = files.sparkSession
    spark.dataSource.register(FilesSource)
    files.select("path", "value").write.format(NAME).mode(mode).save(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(path, value) of the files that were committed, the newest of each path; paths are below ``folder``."""
    version, files, root = Table(spark, folder).current(), Files(spark, folder), folder.rstrip("/")
    layers = [layer for _, layer in sorted(version.parts.items())] if version else []
    there = [f"{root}/{lists(layer)}" for layer in layers if files.exists(lists(layer))]
    if unlisted := [layer for layer in layers if not files.exists(lists(layer)) and files.names(layer)]:
        raise ValueError(f"{folder}: {unlisted} has files and no list of them")
    if not there:
        return spark.createDataFrame([], SCHEMA)
    order = F.create_map(*[F.lit(x) for at, layer in enumerate(layers) for x in (layer[2:], at)])
    at = order[F.regexp_extract(F.col("_metadata.file_path"), r"/l-([0-9a-f]{32})/[^/]*$", 1)]
    newest = spark.read.schema("path string").json(there).groupBy("path").agg(F.max(at).alias("at"))

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = opened(root)
        made = lambda rows: pa.RecordBatch.from_pydict({"path": pa.array([r[0] for r in rows], pa.string()), "value": pa.array([r[1] for r in rows], pa.string())})
        for b in batches:
            rows, chars = [], 0
            for path, k in zip(b.column("path").to_pylist(), b.column("at").to_pylist()):
                with fs.open_input_stream(f"{top}/{layers[k]}/{path}", compression=None) as file:
                    rows.append((path, file.read().decode()))
                chars += len(rows[-1][1])
                if chars >= CHARS or len(rows) >= FILES:
                    yield made(rows)
                    rows, chars = [], 0
            if rows:
                yield made(rows)

    return newest.repartition(READERS * spark.sparkContext.defaultParallelism).mapInArrow(contents, SCHEMA)
