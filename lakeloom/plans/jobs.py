"""Job queue on the driver: states in the store, work as Spark jobs in groups that can be cancelled."""

from __future__ import annotations

import os
import threading
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timezone
from enum import Enum

from pyspark.sql import functions as F

from lakeloom.sources.store import TABLES, Store

STATES = ("queued", "active", "paused", "done", "failed", "cancelled")


class Stage(Enum):
    """Stages of indexing; the first four are pass one."""

    SCAN = 1
    FINGERPRINT = 2
    TECHNICAL_METADATA = 3
    SEARCH_INDEX_METADATA = 4
    DERIVATIVES = 5
    DUPLICATE_DETECTION = 6
    SCENE_DETECTION = 7
    TAGGING = 8
    SEARCH_INDEX_FULL_TEXT = 9

    @property
    def in_first_pass(self) -> bool:
        return self.value <= 4


class Cancelled(Exception):
    """The job was cancelled; raised by check() in its worker."""


class Paused(Exception):
    """The job is to rest: its worker ends, and begins again where it was once the job is resumed."""


class JobContext:
    """What a worker may ask and tell; progress is kept in whole percents."""

    def __init__(self, queue: JobQueue, job_id: str) -> None:
        self.queue, self.id, self._percent = queue, job_id, -1

    def is_cancelled(self) -> bool:
        return self.queue.get(self.id)["status"] == "cancelled"

    def is_paused(self) -> bool:
        return self.queue.get(self.id)["status"] == "paused"

    def check(self) -> None:
        """For a worker between two chunks of its work: raises if the job is no longer to run."""
        status = self.queue.get(self.id)["status"]
        if status == "cancelled":
            raise Cancelled(self.id)
        if status == "paused":
            raise Paused(self.id)

    def report_progress(self, p: float) -> None:
        p = min(1.0, max(0.0, p))
        if int(100 * p) != self._percent:
            self._percent = int(100 * p)
            self.queue._update(self.id, progress=p)


class JobQueue:
    def __init__(self, store: Store, workers: dict[str, Callable[[JobContext, dict], str | None]] | None = None) -> None:
        self.store = store
        self.parallel = min(8, max(1, os.cpu_count() or 1))
        self._lock, self._work, self._running = threading.RLock(), {}, set()
        self.workers = {"derivatives": lambda c, j: "skipped: no decoder", "tagging": lambda c, j: "skipped: no model"} | (workers or {})
        self.recover_interrupted()

    def list(self) -> list[dict]:
        return [r.asDict() for r in self.store.table("jobs").orderBy("created_at").collect()]  # the control plane: a row a job

    def get(self, job_id: str) -> dict | None:
        row = self.store.table("jobs").where(F.col("id") == job_id).first()
        return row.asDict() if row else None

    def _put(self, job: dict) -> None:
        schema = TABLES["jobs"][0]
        names = [f.strip().split(" ")[0] for f in schema.split(",")]
        with self._lock:
            self.store.upsert("jobs", self.store.spark.createDataFrame([tuple(job[n] for n in names)], schema))

    def _update(self, job_id: str, **values) -> None:
        with self._lock:
            job = self.get(job_id)
            if job is None:
                raise KeyError(job_id)
            self._put(job | values | {"updated_at": datetime.now(timezone.utc)})

    def recover_interrupted(self) -> int:
        active = [j for j in self.list() if j["status"] == "active"]
        for j in active:
            self._update(j["id"], status="queued", progress=0.0)
        return len(active)

    def enqueue(self, archive_id: str | None, kind: str, work: Callable | None = None, stage: Stage | None = None, after: str | None = None) -> str:
        """A queued job; with `after`, one that waits until that job is done, and goes with it if it fails or is cancelled."""
        if archive_id is not None and self.store.table("archives").where(F.col("id") == archive_id).isEmpty():
            raise KeyError(f"no archive {archive_id}")
        if after is not None and self.get(after) is None:
            raise KeyError(f"no job {after}")
        now = datetime.now(timezone.utc)
        job = {"id": str(uuid.uuid4()), "archive_id": archive_id, "kind": kind, "status": "queued", "progress": 0.0, "error": None, "note": None, "created_at": now, "updated_at": now, "stage": stage and stage.name.lower(), "after": after}
        self._put(job)
        if work:
            self._work[job["id"]] = work
        return job["id"]

    def cancel(self, job_id: str) -> None:
        if self.get(job_id)["status"] in ("queued", "active", "paused"):
            self._update(job_id, status="cancelled", error="cancelled by user")
            self.store.spark.sparkContext.cancelJobGroup(job_id)

    def pause(self, job_id: str) -> None:
        if self.get(job_id)["status"] in ("queued", "active"):
            self._update(job_id, status="paused")

    def resume(self, job_id: str, requeue: bool = False) -> None:
        """Paused to active while its worker is still at it, else back to the queue; requeue sends it there in any case."""
        with self._lock:
            if self.get(job_id)["status"] == "paused":
                self._update(job_id, status="active" if job_id in self._running and not requeue else "queued")

    def _end(self, job_id: str, **values) -> None:
        """A worker's last word, which doesn't overwrite what was said of its job meanwhile."""
        with self._lock:
            self._running.discard(job_id)
            if self.get(job_id)["status"] == "active":
                self._update(job_id, **values)

    def _run(self, job: dict) -> None:
        job_id = job["id"]
        work = self._work.get(job_id) or self.workers.get(job["kind"])
        with self._lock:
            if self.get(job_id)["status"] != "queued":  # cancelled or paused since it was listed
                return
            self._running.add(job_id)
            self._update(job_id, status="active")
        self.store.spark.sparkContext.setJobGroup(job_id, job["kind"], interruptOnCancel=True)
        try:
            note = work(JobContext(self, job_id), job) if work else f"no worker for {job['kind']}"
        except Paused:
            with self._lock:
                self._running.discard(job_id)
                if self.get(job_id)["status"] == "active":  # resumed while the worker was on its way out
                    self._update(job_id, status="queued")
        except Cancelled:
            self._end(job_id)
        except Exception as e:  # a worker's failure is its job's state
            self._end(job_id, status="failed", error=str(e))
        else:
            with self._lock:
                # Whole work counts, even if a pause came after its last chunk.
                self._running.discard(job_id)
                if self.get(job_id)["status"] in ("active", "paused"):
                    self._update(job_id, status="done", progress=1.0, note=note)

    def ready(self) -> list[dict]:
        """Queued jobs, oldest first, whose predecessors are done; those of failed or cancelled predecessors are cancelled."""
        jobs = self.list()
        status = {j["id"]: j["status"] for j in jobs}
        found, settled = [], False
        while not settled:  # a cancelled job's own successors go too
            settled, found = True, []
            for j in (j for j in jobs if status[j["id"]] == "queued"):
                before = status.get(j["after"]) if j["after"] else "done"
                if before == "done":
                    found.append(j)
                elif before not in ("queued", "active", "paused"):
                    self._update(j["id"], status="cancelled", error=f"job {j['after']} before it was {before or 'lost'}")
                    status[j["id"]], settled = "cancelled", False
        return found

    def run_until_idle(self) -> None:
        """Batches of `parallel` jobs that are ready, each batch to its end."""
        while batch := self.ready()[: self.parallel]:
            with ThreadPoolExecutor(len(batch)) as pool:
                list(pool.map(self._run, batch))

    def run_in_background(self) -> threading.Thread:
        t = threading.Thread(target=self.run_until_idle, daemon=True)
        t.start()
        return t
