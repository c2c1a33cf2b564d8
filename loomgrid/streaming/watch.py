"""Directory watching, scheduled jobs, and event-time streams.

A file is loaded again when its size or time changes. Spark's file source never emits a changed path twice, so changes
are found by a driver poll that runs the batch reader; new files alone can be streamed with ``stream_files``.
"""

from __future__ import annotations

import os
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.sources import readers

WATCHED = frozenset(readers.EXTENSIONS) - {"toml", "ini", "cfg", "fwf", "txt"}


@dataclass
class Watcher:
    """Loads the files of one folder into tables named after them."""

    spark: SparkSession
    folder: str
    seen: dict[str, tuple[int, float]] = field(default_factory=dict)
    errors: dict[str, str] = field(default_factory=dict)

    def poll(self) -> list[str]:
        """Loads new and changed files; a file that fails is not tried again before it changes."""
        loaded = []
        for e in sorted(os.scandir(self.folder), key=lambda x: x.name):
            if not e.is_file() or e.name.rpartition(".")[2].lower() not in WATCHED:
                continue
            mark = (e.stat().st_size, e.stat().st_mtime)
            if self.seen.get(e.path) == mark:
                continue
            self.seen[e.path] = mark
            try:
                name = readers.table_name_of(e.path)
                readers.read(self.spark, e.path).write.mode("overwrite").saveAsTable(name)
                self.errors.pop(e.path, None)
                loaded.append(name)
            except Exception as x:  # noqa: BLE001  (kept for the user; other files go on)
                self.errors[e.path] = str(x)[:500]
        return loaded

    def run(self, stop: threading.Event, seconds: float = 3.0) -> None:
        while not stop.wait(seconds):
            self.poll()


def stream_files(spark: SparkSession, folder: str, schema: str, fmt: str = "csv", glob: str = "*", **options: str) -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).options(pathGlobFilter=glob, **options).load(folder)


def windowed_counts(events: DataFrame, time_col: str, key: str, window: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts per event-time window and key; what is later than ``late`` is dropped by the watermark."""
    w = F.window(time_col, window, slide) if slide else F.window(time_col, window)
    return events.withWatermark(time_col, late).groupBy(w, key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), key, "n")


def deduplicated(events: DataFrame, time_col: str, key: str, late: str = "1 hour") -> DataFrame:
    return events.withWatermark(time_col, late).dropDuplicatesWithinWatermark([key])


def cron_matches(expr: str, at: datetime) -> bool:
    """Five fields: minute, hour, day, month, weekday (0 or 7: Sunday); lists, ranges and steps. Days match as cron does."""
    fields = expr.split()
    if len(fields) != 5:
        raise ValueError(f"five cron fields are needed: {expr}")

    def fits(f: str, v: int, low: int, high: int) -> bool:
        for part in f.split(","):
            body, _, step = part.partition("/")
            a, b = (low, high) if body == "*" else (int(body.split("-")[0]), int(body.split("-")[-1]) if "-" in body or not step else high)
            if v in range(a, b + 1, int(step or 1)):
                return True
        return False

    weekday = at.isoweekday() % 7
    day = fits(fields[2], at.day, 1, 31)
    week = fits(fields[4], weekday, 0, 7) or weekday == 0 and fits(fields[4], 7, 0, 7)
    days = day and week if "*" in (fields[2], fields[4]) else day or week
    return fits(fields[0], at.minute, 0, 59) and fits(fields[1], at.hour, 0, 23) and fits(fields[3], at.month, 1, 12) and days


@dataclass
class Job:
    name: str
    action: Callable[[SparkSession], object]
    kind: str = "MANUAL"  # MANUAL, CRON, INTERVAL, ONCE
    cron: str = ""
    every: timedelta = timedelta(0)
    at: datetime | None = None
    enabled: bool = True
    no_overlap: bool = True
    max_seconds: float | None = None
    last: datetime | None = None
    running: int = 0
    history: list[dict] = field(default_factory=list)

    def due(self, now: datetime) -> bool:
        if not self.enabled or self.no_overlap and self.running:
            return False
        if self.kind == "CRON":
            return cron_matches(self.cron, now) and (self.last is None or self.last.replace(second=0, microsecond=0) < now.replace(second=0, microsecond=0))
        if self.kind == "INTERVAL":
            return self.last is None or now - self.last >= self.every
        return self.kind == "ONCE" and self.last is None and self.at is not None and now >= self.at


class Scheduler:
    """Runs jobs that are due, each in a job group that is cancelled after its longest time."""

    def __init__(self, spark: SparkSession, read_only: bool = False):
        self.spark, self.read_only, self.jobs = spark, read_only, {}

    def add(self, job: Job) -> None:
        self.jobs[job.name] = job

    def run(self, name: str, now: datetime | None = None) -> dict:
        job, sc, group = self.jobs[name], self.spark.sparkContext, uuid.uuid4().hex
        job.last, began = now or datetime.now(), time.time()
        if self.read_only:
            row = {"status": "skipped", "seconds": 0.0, "error": "read-only mode"}
            job.history.append(row)
            return row
        job.running += 1
        sc.setJobGroup(group, name, True)
        timer = threading.Timer(job.max_seconds, sc.cancelJobGroup, [group]) if job.max_seconds else None
        if timer:
            timer.start()
        try:
            job.action(self.spark)
            row = {"status": "succeeded", "error": ""}
        except Exception as e:  # noqa: BLE001  (recorded in the history)
            row = {"status": "failed", "error": str(e)[:500]}
        finally:
            if timer:
                timer.cancel()
            job.running -= 1
        row["seconds"] = time.time() - began
        job.history.append(row)
        return row

    def tick(self, now: datetime | None = None) -> list[str]:
        now = now or datetime.now()
        due = [j.name for j in self.jobs.values() if j.due(now)]
        for name in due:
            self.run(name, now)
        return due
