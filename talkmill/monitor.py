"""Monitoring of runs: events as JSON lines, a status file, limits on time and memory, a stop file."""

from __future__ import annotations

import json
import os
import threading
import time
from pathlib import Path

from pyspark.sql import SparkSession

from talkmill.sinks.files import atomic


class Monitor:
    """A context in which a thread writes status once a second and cancels the jobs beyond a limit.

    exit_code is 0 after an ordinary end or a stop file, 2 after a limit on the driver's memory (MB) or the run time (seconds).
    """

    def __init__(self, spark: SparkSession, events: str | None = None, status: str | None = None, max_rss_mb: int | None = None, max_seconds: float | None = None, stop_file: str | None = None, every: float = 1.0):
        self.spark, self.events, self.status, self.every = spark, events, status, every
        self.max_rss_mb, self.max_seconds, self.stop_file = max_rss_mb, max_seconds, stop_file
        self.exit_code, self.reason = 0, ""
        self._end, self._began = threading.Event(), 0.0

    def event(self, kind: str, **data: object) -> None:
        if self.events:
            with open(self.events, "a", encoding="utf-8") as f:
                f.write(json.dumps({"time": time.time(), "event": kind} | data) + "\n")

    def snapshot(self) -> dict[str, object]:
        t = self.spark.sparkContext.statusTracker()
        rss = int(Path("/proc/self/statm").read_text().split()[1]) * os.sysconf("SC_PAGE_SIZE") >> 20
        return {"seconds": round(time.time() - self._began, 3), "driver_rss_mb": rss, "active_jobs": len(t.getActiveJobsIds()), "active_stages": len(t.getActiveStageIds())}

    def _stop(self, reason: str, code: int) -> None:
        self.reason, self.exit_code = reason, code
        self.event("stopping", reason=reason)
        self.spark.sparkContext.cancelAllJobs()

    def _watch(self) -> None:
        while not self._end.wait(self.every):
            s = self.snapshot()
            if self.status:
                with atomic(self.status) as tmp:
                    tmp.write_text(json.dumps(s))
            if self.reason:
                continue
            if self.stop_file and Path(self.stop_file).exists():
                self._stop("stop file", 0)
            elif self.max_rss_mb and s["driver_rss_mb"] > self.max_rss_mb:
                self._stop("memory", 2)
            elif self.max_seconds and s["seconds"] > self.max_seconds:
                self._stop("time", 2)

    def __enter__(self) -> Monitor:
        self._began = time.time()
        self.event("started", pid=os.getpid())
        self._thread = threading.Thread(target=self._watch, daemon=True)
        self._thread.start()
        return self

    def __exit__(self, kind, error, trace) -> bool:
        self._end.set()
        self._thread.join()
        self.event("failed" if error and not self.reason else "ended", error=str(error)[:500] if error else None, reason=self.reason or None)
        return bool(self.reason and error)
