"""Jobs that outlive their driver: a queue in a commit log, with leases.

Every step of a job is a row, written by a commit that fails if another one came first; so of two workers that want a job one gets it, and a job whose worker is gone is taken over when its lease is over.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.store import Log
from .jobs import STATES

SCHEMAS = {"jobs": "job_id string, seq long, status string, payload string, worker string, lease double, attempts int, progress double, message string, created double, updated double"}
_COLUMNS = [c.split(" ")[0] for c in SCHEMAS["jobs"].split(", ")]


class Lost(RuntimeError):
    """The job is no longer this worker's: its lease was over and another one took it, or it was cancelled."""


class DurableQueue(Log):
    """Jobs with text payloads. Handlers must be safe to run again: a worker that loses its lease may have done a part."""

    def __init__(self, spark: SparkSession, path: str, lease: float = 60.0, retries: int = 3, worker: str | None = None, clock: Callable[[], float] = time.time):
        super().__init__(spark, path, SCHEMAS)
        self.lease, self.retries, self.worker, self.clock = lease, retries, worker or uuid.uuid4().hex, clock
        self.create()

    def jobs(self, state: dict | None = None) -> DataFrame:
        """The last row of each job."""
        last = W.partitionBy("job_id").orderBy(F.desc("seq"))
        return self.read("jobs", state).withColumn("_last", F.row_number().over(last)).where("_last = 1").drop("_last")

    def _step(self, choose: Callable[[DataFrame], DataFrame], change: Callable[[dict], dict | None]) -> dict | None:
        """One row for the first job that choose leaves of the newest state, as change makes it; None if there is none or change gives None. Made again if another worker was first."""
        made: list[dict | None] = []

        def step(state: dict) -> dict:
            found = choose(self.jobs(state)).limit(1).collect()
            new = change(found[0].asDict()) if found else None
            made[:] = [new]
            if new is None:
                return {}
            new |= {"seq": new["seq"] + 1, "updated": self.clock()}
            rows = self.spark.createDataFrame([tuple(new[c] for c in _COLUMNS)], SCHEMAS["jobs"])
            return {"jobs": self._added(state, "jobs", rows)}

        self.change(step)
        return made[0]

    def enqueue(self, payload: str) -> str:
        job, now = uuid.uuid4().hex, self.clock()
        self.append("jobs", self.spark.createDataFrame([(job, 0, "pending", payload, None, None, 0, 0.0, None, now, now)], SCHEMAS["jobs"]))
        return job

    def claim(self) -> dict | None:
        """The oldest job that is pending, or whose worker's lease is over; it is this worker's now. None if there is none."""
        now = self.clock()
        free = (F.col("status") == "pending") & (F.coalesce("lease", F.lit(0.0)) <= now) | (F.col("status") == "processing") & (F.col("lease") <= now)
        return self._step(lambda jobs: jobs.where(free).orderBy("created", "job_id"), lambda job: job | {"status": "processing", "worker": self.worker, "lease": self.clock() + self.lease, "attempts": job["attempts"] + 1})

    def _own(self, job_id: str, **values: object) -> dict:
        """Change a job that is still this worker's."""
        made = self._step(lambda jobs: jobs.where(F.col("job_id") == job_id), lambda job: job | values if (job["status"], job["worker"]) == ("processing", self.worker) else None)
        if made is None:
            raise Lost(job_id)
        return made

    def report(self, job_id: str, progress: float, message: str | None = None) -> None:
        """Progress in percent; the lease begins again."""
        self._own(job_id, progress=float(progress), message=message, lease=self.clock() + self.lease)

    def complete(self, job_id: str, message: str | None = None) -> None:
        self._own(job_id, status="completed", progress=100.0, message=message, lease=None)

    def fail(self, job_id: str, message: str, delay: float = 0.0) -> str:
        """The job is tried again after delay seconds, or failed for good after `retries` more attempts; its status."""
        job = self.get(job_id)
        again = job is not None and job["attempts"] <= self.retries
        return self._own(job_id, status="pending" if again else "failed", message=message, lease=self.clock() + delay if again else None)["status"]

    def cancel(self, job_id: str) -> bool:
        """A pending job never starts; the worker of a running one finds it lost at its next report."""
        return self._step(lambda jobs: jobs.where(F.col("job_id") == job_id), lambda job: job | {"status": "cancelled", "lease": None} if job["status"] in ("pending", "processing") else None) is not None

    def get(self, job_id: str) -> dict | None:
        found = self.jobs().where(F.col("job_id") == job_id).collect()
        return found[0].asDict() if found else None

    def list(self, status: str | None = None) -> DataFrame:
        """Newest first."""
        jobs = self.jobs()
        return (jobs.where(F.col("status") == status) if status else jobs).orderBy(F.desc("created"), "job_id")

    def counts(self) -> dict[str, int]:
        found = {r["status"]: r["n"] for r in self.jobs().groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
        return {s: found.get(s, 0) for s in STATES}

    def run(self, handler: Callable[[str, Callable[[float], None]], object], most: int | None = None, base_delay: float = 1.0) -> int:
        """Work on jobs, handler(payload, report), until none is free (or `most` are done); how many were taken. A failure is tried again after 1, 2, 4, ... times base_delay."""
        taken = 0
        while (most is None or taken < most) and (job := self.claim()):
            taken += 1
            try:
                try:
                    result = handler(job["payload"], lambda p, j=job["job_id"]: self.report(j, p))
                except Lost:
                    raise
                except Exception as e:
                    self.fail(job["job_id"], str(e), base_delay * 2 ** (job["attempts"] - 1))
                else:
                    self.complete(job["job_id"], None if result is None else str(result))
            except Lost:
                continue
        return taken
