"""Scans as things that run: the latest one of a location wins, and each says how far it is."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import SparkSession

from gleaner.sources.files import Cancelled

#: Seconds between reports that are not important.
INTERVAL = 0.1
#: The states of a scan, in order.
STATES = ("discovering", "hashing", "reading", "embedding", "done", "failed")


@dataclass(frozen=True)
class Status:
    location_id: int
    state: str = "discovering"
    files_found: int = 0
    files_processed: int = 0
    files_changed: int = 0
    files_failed: int = 0
    unreadable: int = 0
    files_to_read: int = 0
    files_read: int = 0
    read_failed: int = 0
    passages_to_embed: int = 0
    passages_embedded: int = 0
    error: str | None = None

    @property
    def running(self) -> bool:
        return self.state not in ("done", "failed")

    @property
    def percent(self) -> float | None:
        """Of the step that runs; None while its size is not known."""
        if self.state == "done":
            return 100.0
        of = {"hashing": (self.files_processed, self.files_found), "reading": (self.files_read, self.files_to_read), "embedding": (self.passages_embedded, self.passages_to_embed)}
        done, total = of.get(self.state, (0, 0))
        return done / total * 100 if total > 0 else None


class Scan:
    """One run over a location. Its Spark jobs carry its tag, so that cancelling it ends them wherever they are."""

    def __init__(self, scans: Scans, location_id: int, report: Callable[[Status], None] | None):
        self.scans, self.location_id, self.report = scans, location_id, report
        self.tag, self.stopped, self.status, self._last = f"scan-{location_id}-{uuid.uuid4().hex}", False, Status(location_id), 0.0

    def cancel(self) -> None:
        self.stopped = True
        self.scans.spark.sparkContext.cancelJobsWithTag(self.tag)

    def check(self) -> None:
        if self.stopped or not self.scans.is_current(self):
            raise Cancelled

    def say(self, important: bool = False, **changes) -> None:
        """Stores the status, and reports it if it is important or the last report is a while ago. A scan that is no
        longer the location's own says nothing."""
        if self.stopped or not self.scans.is_current(self):
            return
        important = important or "state" in changes and changes["state"] != self.status.state
        self.status = replace(self.status, **changes)
        now = time.monotonic()
        if self.report is not None and (important or now - self._last >= INTERVAL):
            self._last = now
            self.report(self.status)

    def tasks(self) -> tuple[int, int]:
        """Tasks done and tasks in all of the scan's running stages."""
        tracker = self.scans.spark.sparkContext.statusTracker()
        ids = self.scans.spark.sparkContext._jsc.sc().statusTracker().getJobIdsForTag(self.tag)
        done = total = 0
        for job in ids:
            info = tracker.getJobInfo(job)
            for stage in info.stageIds if info is not None and info.status == "RUNNING" else ():
                if (s := tracker.getStageInfo(stage)) is not None and s.numActiveTasks:
                    done, total = done + s.numCompletedTasks, total + s.numTasks
        return done, total

    def following(self, **of: int) -> Following:
        """While it is open, each counter named follows the share of tasks done, up to the number given."""
        return Following(self, of)

    def __enter__(self) -> Scan:
        self.scans.spark.sparkContext.addJobTag(self.tag)
        return self

    def __exit__(self, kind, error, trace) -> None:
        self.scans.spark.sparkContext.removeJobTag(self.tag)
        if error is None:
            return
        if self.stopped and not isinstance(error, Cancelled):
            raise Cancelled from error
        if not isinstance(error, Cancelled):
            self.say(state="failed", error=str(error).split("\n")[0][:200])


class Following:
    def __init__(self, scan: Scan, of: dict[str, int]):
        self.scan, self.of, self.over = scan, of, threading.Event()
        self.thread = threading.Thread(target=self.run, daemon=True)

    def run(self) -> None:
        while not self.over.wait(INTERVAL):
            done, total = self.scan.tasks()
            if total:
                self.scan.say(**{k: n * done // total for k, n in self.of.items()})

    def __enter__(self) -> None:
        self.thread.start()

    def __exit__(self, *_) -> None:
        self.over.set()
        self.thread.join()


class Scans:
    """The scans of a library, at most one a location."""

    def __init__(self, spark: SparkSession):
        self.spark, self._lock, self._current = spark, threading.Lock(), {}

    def begin(self, location_id: int, report: Callable[[Status], None] | None = None) -> Scan:
        """A new scan of the location; the one that runs is cancelled."""
        new = Scan(self, location_id, report)
        with self._lock:
            old = self._current.get(location_id)
            self._current[location_id] = new
        if old is not None and old.status.running:
            old.cancel()
        return new

    def is_current(self, scan: Scan) -> bool:
        with self._lock:
            return self._current.get(scan.location_id) is scan

    def forget(self, location_id: int) -> None:
        """Ends the location's scan and drops its status."""
        with self._lock:
            old = self._current.pop(location_id, None)
        if old is not None:
            old.cancel()

    def status(self, location_id: int) -> Status | None:
        with self._lock:
            found = self._current.get(location_id)
        return None if found is None else found.status
