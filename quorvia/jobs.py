"""Queries as jobs: idempotent submission, state, deadline and cancellation by job tags; and approvals
of plans that are large enough to need one."""

from __future__ import annotations

import hashlib
import json
import threading
import time
import uuid
from collections.abc import Callable

from pyspark import InheritableThread
from pyspark.sql import SparkSession


class Jobs:
    """Jobs of one session. A job's function runs in a thread of its own under a tag; ``cancel``
    interrupts what Spark runs under it."""

    def __init__(self, spark: SparkSession):
        self.spark, self._jobs, self._lock = spark, {}, threading.Lock()

    def submit(self, key: str, fn: Callable[[SparkSession], object], *, seconds: float | None = None) -> str:
        """The job of that key; submitting a key again gives the same job."""
        with self._lock:
            if key in self._jobs:
                return self._jobs[key]["id"]
            job = {"id": uuid.uuid4().hex, "state": "RUNNING", "result": None, "error": None, "tag": f"quorvia-{uuid.uuid4().hex}", "done": threading.Event()}
            self._jobs[key] = job

        def run() -> None:
            context = self.spark.sparkContext
            context.addJobTag(job["tag"])
            context.setInterruptOnCancel(True)
            try:
                got = fn(self.spark)
                self._end(job, "SUCCEEDED", result=got)
            except Exception as error:  # noqa: BLE001 - it is the job's outcome
                self._end(job, "FAILED", error=str(error)[:500])
            finally:
                context.removeJobTag(job["tag"])

        InheritableThread(target=run, daemon=True).start()
        if seconds is not None:
            timer = threading.Timer(seconds, lambda: self.cancel(key, "EXPIRED"))
            timer.daemon = True
            timer.start()
        return job["id"]

    def _end(self, job: dict, state: str, **found) -> None:
        with self._lock:
            if job["state"] == "RUNNING":
                job.update(found, state=state)
        job["done"].set()

    def cancel(self, key: str, state: str = "CANCELLED") -> None:
        job = self._jobs[key]
        with self._lock:
            if job["state"] != "RUNNING":
                return
            job["state"] = state
        self.spark.sparkContext.cancelJobsWithTag(job["tag"])

    def state(self, key: str) -> str:
        return self._jobs[key]["state"]

    def result(self, key: str, timeout: float | None = None):
        job = self._jobs[key]
        job["done"].wait(timeout)
        if job["state"] != "SUCCEEDED":
            raise RuntimeError(f"the job is {job['state']}: {job['error']}")
        return job["result"]


class Approvals:
    """Approvals are for one plan, by its hash, and expire."""

    def __init__(self):
        self._until: dict[str, float] = {}

    @staticmethod
    def plan_hash(operator: str, arguments: dict) -> str:
        return hashlib.sha256(json.dumps([operator, arguments], sort_keys=True, default=str).encode()).hexdigest()

    def grant(self, plan: str, seconds: float = 600.0) -> None:
        self._until[plan] = time.monotonic() + seconds

    def valid(self, plan: str) -> bool:
        return self._until.get(plan, 0.0) > time.monotonic()
