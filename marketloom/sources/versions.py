"""Tables as versions: folders of data that are never changed, and small numbered files that name them.

    table/_versions/000000000007.json     the parts of version 7 and the ledger
    table/d-<id>/...                      data

The newest number is the table.  A new version is written beside the old one and becomes the table by one rename of its
file, which fails if another writer took the number: a reader sees one version or the next at every instant, never a part
of one, whatever task or driver dies.  What a dead writer left is named by no version; ``vacuum`` removes it.

A table may be split by a column's values into parts, each a folder: a new version then names the old folders of the
parts that it doesn't touch.  The ledger tells which batches of which stream a version holds; it is committed with them.

All files go through Hadoop's file systems (``common.Files``), so a table may lie wherever Spark reads and writes.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Part of a table that isn't split; label column of one that is.
WHOLE, LABEL = "all", "_label"
#: Seconds for which what no version names is kept: another writer may be about to name it, or a reader be at it.
GRACE = 24 * 3600


class Conflict(RuntimeError):
    """Another writer has committed meanwhile."""


class Files:
    """The few operations on a Hadoop file system that tables need."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._hadoop, self._conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
        self._fs = self._hadoop.Path(self.root).getFileSystem(self._conf)

    def at(self, name: str):
        return self._hadoop.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self.at(name))

    def names(self, name: str = "") -> dict[str, int]:
        """Names in a folder, with the time of their last change in milliseconds."""
        if not self.exists(name):
            return {}
        return {x.getPath().getName(): x.getModificationTime() for x in self._fs.listStatus(self.at(name))}

    def read(self, name: str) -> str:
        stream = self._fs.open(self.at(name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str, overwrite: bool = False) -> None:
        out = self._fs.create(self.at(name), overwrite)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def publish(self, name: str, text: str) -> bool:
        """Make a file with its whole content, unless there is one."""
        folder, _, last = name.rpartition("/")
        staged = f"{folder}/.{last}-{uuid.uuid4().hex}"
        self.create(staged, text)
        context = self._hadoop.FileContext.getFileContext(self._fs.getUri(), self._conf)
        none = self.spark.sparkContext._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 0)
        try:
            context.rename(self.at(staged), self.at(name), none)
            return True
        except Exception as error:
            self.delete(staged)
            if "FileAlreadyExists" in str(error):
                return False
            raise

    def delete(self, name: str) -> None:
        self._fs.delete(self.at(name), True)


@dataclass(frozen=True)
class Version:
    number: int
    parts: dict[str, str]  # label -> folder
    schema: str  # as JSON
    ledger: dict[str, int] = field(default_factory=dict)

    def text(self) -> str:
        return json.dumps({"parts": self.parts, "schema": self.schema, "ledger": self.ledger})


def label(value: Column) -> Column:
    """A folder's name for a value of the column by which a table is split; different for different values."""
    text = value.cast("string")
    return F.when(text.isNull(), "null").when(text.rlike("^[0-9A-Za-z.-]{1,64}$"), F.concat(F.lit("v"), text)).otherwise(F.concat(F.lit("x"), F.hex(F.encode(text, "UTF-8"))))


class Table:
    """A table at ``path``, in one of Spark's file formats; ``split`` names the column that decides a row's part."""

    def __init__(self, spark: SparkSession, path: str, kind: str = "parquet", split: str | None = None, **options):
        self.spark, self.path, self.kind, self.split, self.options = spark, path.rstrip("/"), kind, split, options
        self.files = Files(spark, path)

    def numbers(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.files.names("_versions") if n.endswith(".json") and not n.startswith("."))

    def version(self, number: int) -> Version:
        found = json.loads(self.files.read(f"_versions/{number:012}.json"))
        return Version(number, found["parts"], found["schema"], found["ledger"])

    def current(self) -> Version | None:
        for _ in range(10):
            numbers = self.numbers()
            if not numbers:
                return None
            try:
                return self.version(numbers[-1])
            except Exception:  # removed by a vacuum after newer ones came
                if self.numbers()[-1:] == numbers[-1:]:
                    raise
        raise Conflict(f"{self.path} is changing faster than it can be read")

    def read(self, version: Version | None = None, labels: list[str] | None = None) -> DataFrame | None:
        """The rows of a version (without one, the current), of these parts only; None if there is no table yet."""
        version = version or self.current()
        if version is None:
            return None
        schema = T.StructType.fromJson(json.loads(version.schema))
        folders = sorted({f for p, f in version.parts.items() if labels is None or p in labels})
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.format(self.kind).schema(schema).options(**self.options).load([f"{self.path}/{f}" for f in folders])

    def stage(self, rows: DataFrame) -> dict[str, str]:
        """Write rows to a folder that no version names yet; label -> folder of each part."""
        folder = f"d-{uuid.uuid4().hex}"
        own, options = rows, {k: v for k, v in self.options.items() if k != "multiLine"}
        if self.split is None:
            own.write.format(self.kind).options(**options).save(f"{self.path}/{folder}")
            return {WHOLE: folder}
        own = rows.withColumn(LABEL, label(F.col(self.split)))
        own.write.format(self.kind).options(**options).partitionBy(LABEL).save(f"{self.path}/{folder}")
        prefix = f"{LABEL}="
        return {n[len(prefix) :]: f"{folder}/{n}" for n in self.files.names(folder) if n.startswith(prefix)}

    def commit(self, rows: DataFrame, after: Version | None, replaced: list[str] | None = None, ledger: dict[str, int] | None = None) -> Version:
        """The version that follows ``after``: ``rows`` in place of the parts ``replaced`` (without, of all).

        Raises Conflict, and changes nothing, if another version followed meanwhile.
        """
        staged = self.stage(rows)
        kept = {} if replaced is None or after is None else {p: f for p, f in after.parts.items() if p not in replaced}
        if clash := sorted(set(kept) & set(staged)):
            raise ValueError(f"rows of parts that aren't replaced: {clash[:5]}")
        new = Version((after.number if after else 0) + 1, kept | staged, rows.schema.json(), (after.ledger if after else {}) | (ledger or {}))
        if not self.files.publish(f"_versions/{new.number:012}.json", new.text()):
            for folder in {f.split("/")[0] for f in staged.values()}:
                self.files.delete(folder)
            raise Conflict(f"version {new.number} of {self.path} was committed by another writer")
        return new

    def replace(self, rows: DataFrame) -> Version:
        """``rows``, which may be read from the table, as the whole table."""
        return self.commit(rows, self.current())

    def append(self, rows: DataFrame, ledger: dict[str, int] | None = None, attempts: int = 5) -> Version:
        """``rows`` behind those that the table has, which aren't read: parts of their own, in the order of their versions."""
        if self.split is not None:
            raise ValueError("rows of a split table belong to its parts; commit them")
        staged = self.stage(rows)[WHOLE]
        for _ in range(attempts):
            now = self.current()
            number = (now.number if now else 0) + 1
            new = Version(number, (now.parts if now else {}) | {f"{WHOLE}-{number:012}": staged}, now.schema if now else rows.schema.json(), (now.ledger if now else {}) | (ledger or {}))
            if self.files.publish(f"_versions/{number:012}.json", new.text()):
                return new
        self.files.delete(staged)
        raise Conflict(f"{self.path} is changing faster than it can be appended to")

    def in_order(self) -> DataFrame | None:
        """The rows with ``_appended``, the number of the version that appended them."""
        now = self.current()
        if now is None or not now.parts:
            return None if now is None else self.read(now).withColumn("_appended", F.lit(0).cast("bigint"))
        number = F.create_map(*[F.lit(x) for p, f in now.parts.items() for x in (f, int(p.rpartition("-")[2]) if "-" in p else 0)])
        return self.read(now).withColumn("_appended", number[F.regexp_extract(F.col("_metadata.file_path"), r"/(d-[0-9a-f]{32})/", 1)].cast("bigint"))

    def change(self, make: Callable[[DataFrame | None], DataFrame], attempts: int = 5) -> Version:
        """Replace the table by what ``make`` makes of it, anew if another writer was faster."""
        for attempt in range(attempts):
            after = self.current()
            try:
                return self.commit(make(self.read(after) if after else None), after)
            except Conflict:
                if attempt + 1 == attempts:
                    raise
        raise AssertionError

    def vacuum(self, keep: int = 2, grace: float = GRACE) -> list[str]:
        """Forget all but the last ``keep`` versions, and remove data that none of them names and that is old enough."""
        numbers = self.numbers()
        for number in numbers[: -max(keep, 1)]:
            self.files.delete(f"_versions/{number:012}.json")
        named = {f.split("/")[0][2:] for number in numbers[-max(keep, 1) :] for f in self.version(number).parts.values()}
        before = (time.time() - grace) * 1000
        gone = [n for n, changed in self.files.names().items() if n[:2] in ("d-", "e-", "l-") and n[2:] not in named and changed <= before]
        for name in gone:
            self.files.delete(name)
        return sorted(gone)
