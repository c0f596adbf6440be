"""A cache of tables by the configuration that they were made from, built by one of several drivers.

    folder/<digest>/lease-000001       who builds, and when it was last heard of (rewritten while it builds)
    folder/<digest>/d-<id>/            data; folder/<digest>/ready names it, folder/<digest>/error-000001 says what failed

Leases, ``ready`` and ``error`` are made once, by a rename that fails if there is one (``versions.Files.publish``): of any
number of drivers one builds and the others wait for it.  A builder that isn't heard of for ``stale`` seconds is taken to
be dead; the next lease's number is then free to take.  If it lives after all, two build, and the first to be ready counts.
A build that failed is an error for those who wait; a later call tries again.
"""

from __future__ import annotations

import hashlib
import json
import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .versions import Files

BEAT, STALE, PATIENCE = 10.0, 60.0, 7200.0


class BuildFailed(RuntimeError):
    """The driver that built the table has failed."""


def digest(config: dict) -> str:
    return hashlib.sha1(json.dumps(config, sort_keys=True).encode()).hexdigest()[:12]


def cached(spark: SparkSession, make: Callable[[], DataFrame], folder: str, config: dict, beat: float = BEAT, stale: float = STALE, patience: float = PATIENCE) -> DataFrame:
    """The table of ``config``: from the cache, or made and written there first by this driver or another."""
    path = f"{folder.rstrip('/')}/{digest(config)}"
    files, waiting_on, began = Files(spark, path), None, time.monotonic()
    while not files.exists("ready"):
        names = files.names()
        leases = sorted(n for n in names if n.startswith("lease-"))
        last = leases[-1] if leases else None
        failed = last is not None and f"error-{last[6:]}" in names
        if failed and last == waiting_on:
            raise BuildFailed(json.loads(files.read(f"error-{last[6:]}"))["error"])
        if last is None or failed or time.time() - _heard(files, last) > stale:
            number = int(last[6:]) + 1 if last else 1
            if files.publish(f"lease-{number:06}", json.dumps({"at": time.time()})):
                _build(files, make, f"{number:06}", beat)
                continue
        elif time.monotonic() - began > patience:
            raise TimeoutError(f"{path} wasn't ready after {patience:.0f} seconds")
        else:
            waiting_on = last
        time.sleep(min(beat, 1.0))
    return spark.read.parquet(f"{path}/{json.loads(files.read('ready'))['data']}")


def _heard(files: Files, lease: str) -> float:
    """When a lease's holder last wrote; a file that is being rewritten is one just heard of."""
    try:
        return json.loads(files.read(lease))["at"]
    except Exception:
        return time.time()


def _build(files: Files, make: Callable[[], DataFrame], number: str, beat: float) -> None:
    ended = threading.Event()

    def keep() -> None:
        while not ended.wait(beat):
            try:
                files.create(f"lease-{number}", json.dumps({"at": time.time()}), overwrite=True)
            except Exception:  # the next beat tries again
                pass

    heart = threading.Thread(target=keep, daemon=True)
    heart.start()
    data = f"d-{uuid.uuid4().hex}"
    try:
        make().write.parquet(f"{files.root}/{data}")
        if not files.publish("ready", json.dumps({"data": data})):
            files.delete(data)  # another was faster
    except Exception as error:
        files.publish(f"error-{number}", json.dumps({"error": f"{type(error).__name__}: {str(error)[:2000]}"}))
        files.delete(data)
        raise
    finally:
        ended.set()
        heart.join()
