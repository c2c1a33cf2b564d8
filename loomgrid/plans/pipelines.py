"""Versioned read-only SQL pipelines with lineage, kept as append-only Parquet tables."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.operators.sqlgate import READ, classify, sources

MAX_STEPS, MAX_PARALLEL, MAX_NAME, MAX_SQL = 32, 4, 128, 64 << 10
DEFINITIONS = "name string, version long, body string, digest string, created_at timestamp, deleted boolean"
RUNS = "run_id string, name string, version long, status string, started_at timestamp, lineage string"


@dataclass
class Step:
    name: str
    sql: str


@dataclass
class Lineage:
    step: str
    sql_sha256: str
    sources: list[str]
    artifact: str = ""
    columns: list[str] = field(default_factory=list)
    row_count: int = 0
    ms: int = 0
    status: str = "skipped"
    error: str = ""


def validate(name: str, steps: list[Step], parallel: int = 1) -> None:
    if not name.strip() or len(name) > MAX_NAME:
        raise ValueError("a name of 1 to 128 characters is needed")
    if not 1 <= len(steps) <= MAX_STEPS or not 1 <= parallel <= MAX_PARALLEL:
        raise ValueError("1 to 32 steps and 1 to 4 at a time are allowed")
    if len({s.name.strip().lower() for s in steps}) < len(steps) or any(not s.name.strip() for s in steps):
        raise ValueError("steps need different names")
    for s in steps:
        if len(s.sql.encode()) > MAX_SQL or classify(s.sql) != READ:
            raise ValueError(f"step {s.name} is not one reading statement of at most 64 KiB")


class Store:
    """Definitions and runs below one folder. Nothing is changed in place: the latest row of a name counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, kind: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{kind}")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], schema)
            raise

    def _append(self, kind: str, schema: str, row: tuple) -> None:
        self.spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(f"{self.path}/{kind}")

    def versions(self, name: str) -> DataFrame:
        return self._read("definitions", DEFINITIONS).where(F.col("name") == name).orderBy(F.desc("version"))

    def latest(self) -> DataFrame:
        """The newest version of each name that is not deleted."""
        cols = [c.split()[0] for c in DEFINITIONS.split(", ")]
        newest = self._read("definitions", DEFINITIONS).groupBy("name").agg(F.max_by(F.struct(*cols), "version").alias("d"))
        return newest.select("d.*").where("NOT deleted").orderBy(F.lower("name"))

    def save(self, name: str, steps: list[Step], parallel: int = 1) -> int:
        validate(name, steps, parallel)
        body = json.dumps({"steps": [asdict(s) for s in steps], "parallel": parallel}, sort_keys=True)
        version = (self.versions(name).agg(F.max("version")).first()[0] or 0) + 1
        now = self.spark.sql("SELECT current_timestamp()").first()[0]
        self._append("definitions", DEFINITIONS, (name, version, body, hashlib.sha256(body.encode()).hexdigest(), now, False))
        return version

    def delete(self, name: str) -> None:
        row = self.versions(name).first()
        if row:
            self._append("definitions", DEFINITIONS, (name, row["version"] + 1, row["body"], row["digest"], row["created_at"], True))

    def load(self, name: str, version: int | None = None) -> tuple[int, list[Step], int]:
        v = self.versions(name).where("NOT deleted" if version is None else F.col("version") == version).first()
        if v is None:
            raise KeyError(name)
        body = json.loads(v["body"])
        return v["version"], [Step(**s) for s in body["steps"]], body["parallel"]

    def run(self, name: str, version: int | None = None) -> tuple[str, list[Lineage]]:
        """Runs the steps, a few at a time; the first error cancels the others. The run is recorded in any case."""
        version, steps, parallel = self.load(name, version)
        validate(name, steps, parallel)
        run_id, sc = uuid.uuid4().hex, self.spark.sparkContext
        now = self.spark.sql("SELECT current_timestamp()").first()[0]
        lineage = [Lineage(s.name, hashlib.sha256(s.sql.encode()).hexdigest(), sources(self.spark, s.sql)) for s in steps]
        failed = False

        def one(k: int) -> None:
            nonlocal failed
            if failed:
                return
            item, began = lineage[k], time.time()
            sc.setJobGroup(run_id, f"{name}: {steps[k].name}", True)
            try:
                df = self.spark.sql(steps[k].sql)
                item.artifact = f"{self.path}/artifacts/{run_id}/{k}"
                df.write.parquet(item.artifact)
                item.columns, item.row_count, item.status = df.columns, self.spark.read.parquet(item.artifact).count(), "succeeded"
            except Exception as e:  # noqa: BLE001  (recorded, and it ends the run)
                item.status, item.error = "skipped" if failed else "failed", str(e)[:500]
                if not failed:
                    failed = True
                    sc.cancelJobGroup(run_id)
            item.ms = int(1000 * (time.time() - began))

        with ThreadPoolExecutor(parallel) as pool:
            list(pool.map(one, range(len(steps))))
        status = "failed" if failed else "succeeded"
        self._append("runs", RUNS, (run_id, name, version, status, now, json.dumps([asdict(x) for x in lineage])))
        return status, lineage

    def runs(self, name: str) -> DataFrame:
        return self._read("runs", RUNS).where(F.col("name") == name).orderBy(F.desc("started_at"))

    def export(self) -> str:
        return json.dumps([{"name": r["name"], "body": r["body"], "digest": r["digest"]} for r in self.latest().collect()])

    def load_bundle(self, bundle: str) -> int:
        """Saves definitions whose digest is not there yet; returns their number."""
        if len(bundle.encode()) > 16 << 20:
            raise ValueError("the bundle is larger than 16 MiB")
        items = json.loads(bundle)
        if len(items) > 512:
            raise ValueError("a bundle holds at most 512 definitions")
        have = {(r["name"], r["digest"]) for r in self.latest().collect()}
        new = 0
        for x in items:
            if (x["name"], x["digest"]) not in have:
                body = json.loads(x["body"])
                self.save(x["name"], [Step(**s) for s in body["steps"]], body["parallel"])
                new += 1
        return new
