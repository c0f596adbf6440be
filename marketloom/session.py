"""Spark session with the settings the engine relies on."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_session(app: str = "marketloom", master: str | None = None, **settings: str) -> SparkSession:
    """A session in UTC with adaptive execution.  Cluster sizes (partitions, memory) are left to the caller."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    fixed = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    return builder.config(map=fixed | settings).getOrCreate()


def load_env(path: str) -> dict[str, str]:
    """The settings KEY=value of a file (comments, ``export`` and quotes allowed), set where the environment has none."""
    if not os.path.isfile(path):
        return {}
    with open(path, encoding="utf-8") as lines:
        pairs = re.findall(r"(?m)^[ \t]*(?:export[ \t]+)?([^\s#=][^=\n]*)=(.*)$", lines.read())
    settings = {key.strip(): value.strip().strip('"').strip("'") for key, value in reversed(pairs)}  # the first of a key counts
    for key, value in settings.items():
        os.environ.setdefault(key, value)
    return settings


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The session's spark.checkpoint.dir; on one machine, where it is unset, a folder of our own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        wanted = spark.conf.get("spark.checkpoint.dir", None)
        if not wanted and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(wanted or os.path.join(tempfile.gettempdir(), f"marketloom-{uuid.uuid4().hex}"))
