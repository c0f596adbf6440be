"""Batch jobs of an outside text service: submit a request file, look again later, fetch the results.

A job's state is a table of one row, so that another driver can go on with it.  The service is an object with
``submit(requests_path) -> id``, ``status(id) -> str`` and ``download(id, results_path)``; nothing here opens a
connection by itself.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import SparkSession

from .versions import Table

STATE = "job_id string, requests string, status string"
#: The states that a job doesn't leave.
DONE, LOST = "completed", ("failed", "expired", "cancelled")


class Service(Protocol):
    def submit(self, requests_path: str) -> str: ...

    def status(self, job_id: str) -> str: ...

    def download(self, job_id: str, results_path: str) -> None: ...


def _remember(spark: SparkSession, state_path: str, *row: str) -> None:
    Table(spark, state_path, "json").replace(spark.createDataFrame([row], STATE).coalesce(1))


def submit(spark: SparkSession, service: Service, requests_path: str, state_path: str) -> str:
    """Hand a request file in and keep the job's id; does not wait."""
    job_id = service.submit(requests_path)
    _remember(spark, state_path, job_id, requests_path, "submitted")
    return job_id


def collect_results(spark: SparkSession, service: Service, state_path: str, results_path: str) -> bool:
    """Look once: False while the job runs; when it is complete its results are downloaded; a lost job is an error."""
    state = Table(spark, state_path, "json").read()
    known = state.first() if state is not None else None
    if known is None:
        raise ValueError(f"no job in {state_path}; submit one first")
    now = service.status(known["job_id"])
    _remember(spark, state_path, known["job_id"], known["requests"], now)
    if now in LOST:
        raise RuntimeError(f"job {known['job_id']} has {now}")
    if now == DONE:
        service.download(known["job_id"], results_path)
    return now == DONE
