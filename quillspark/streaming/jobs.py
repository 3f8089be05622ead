"""Background jobs on the driver: a bounded pool, retries, progress, cancellation by Spark tag."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATES = ("pending", "processing", "completed", "failed", "cancelled")


@dataclass
class Job:
    job_id: str
    status: str = "pending"
    done: int = 0
    total: int = 0
    attempts: int = 0
    error: str | None = None
    result: object = None
    created_at: float = field(default_factory=time.time)
    history: list[tuple[float, str]] = field(default_factory=list)

    @property
    def progress(self) -> float:
        return 100.0 * self.done / self.total if self.total else 0.0


class JobQueue:
    """Runs handler(task, report) on `workers` threads; a failure is tried again after 1, 2, 4, ... seconds, `retries` times.

    Handlers must be safe to run again; what they write should be keyed by the job's id.
    """

    def __init__(self, spark: SparkSession | None, handler: Callable, workers: int = 3, retries: int = 3, base_delay: float = 1.0, notify: Callable[[dict], None] | None = None, sleep: Callable[[float], None] = time.sleep):
        self.spark, self.handler, self.retries, self.base_delay, self.notify, self.sleep = spark, handler, retries, base_delay, notify, sleep
        self._jobs: dict[str, Job] = {}
        self._lock = threading.Lock()
        self._pool = ThreadPoolExecutor(max_workers=workers)

    def enqueue(self, task: object) -> str:
        job = Job(uuid.uuid4().hex)
        self._move(job, "pending")
        with self._lock:
            self._jobs[job.job_id] = job
        self._pool.submit(self._run, job, task)
        return job.job_id

    def _move(self, job: Job, status: str) -> None:
        job.status = status
        job.history.append((time.time(), status))

    def _run(self, job: Job, task: object) -> None:
        with self._lock:
            if job.status == "cancelled":
                return
            self._move(job, "processing")
        if self.spark is not None:
            self.spark.addTag(job.job_id)
        try:
            while True:
                job.attempts += 1
                try:
                    job.result = self.handler(task, lambda done, total: (setattr(job, "done", done), setattr(job, "total", total)))
                    with self._lock:
                        if job.status != "cancelled":
                            self._move(job, "completed")
                    break
                except Exception as e:
                    job.error = str(e)
                    with self._lock:
                        if job.status == "cancelled":
                            break
                        if job.attempts > self.retries:
                            self._move(job, "failed")
                            break
                    self.sleep(self.base_delay * 2 ** (job.attempts - 1))
        finally:
            if self.spark is not None:
                self.spark.removeTag(job.job_id)
        if self.notify and job.status in ("completed", "failed"):
            try:
                self.notify({"job_id": job.job_id, "status": job.status, "error": job.error})
            except Exception as e:
                job.error = f"{job.error or ''} notification failed: {e}".strip()

    def status(self, job_id: str) -> Job | None:
        return self._jobs.get(job_id)

    def cancel(self, job_id: str) -> bool:
        """A pending job never starts; a running one has its Spark work interrupted."""
        with self._lock:
            job = self._jobs.get(job_id)
            if job is None or job.status not in ("pending", "processing"):
                return False
            running = job.status == "processing"
            self._move(job, "cancelled")
        if running and self.spark is not None:
            self.spark.interruptTag(job_id)
        return True

    def list(self, status: str | None = None) -> list[Job]:
        """Newest first."""
        return sorted((j for j in self._jobs.values() if status in (None, j.status)), key=lambda j: -j.created_at)

    def counts(self) -> dict[str, int]:
        return {s: sum(j.status == s for j in self._jobs.values()) for s in STATES}

    def shutdown(self, wait: bool = True) -> None:
        self._pool.shutdown(wait=wait)


def job_counts(log: DataFrame) -> DataFrame:
    """(status, n) over the last row of each job in an append-only log (job_id, status, updated_at)."""
    last = log.groupBy("job_id").agg(F.max_by("status", "updated_at").alias("status"))
    return last.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
