"""Small metadata tables by append and latest-by-key: match configurations and schedules, quality reports, query history, events."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.functions.trees import preview
from loomgrid.operators import geo, linkage
from loomgrid.streaming.watch import cron_matches

SCHEMA = "kind string, key string, body string, seq long, deleted boolean"


class Meta:
    """key -> JSON, by kind. Every write appends; the latest row of a key counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _rows(self) -> DataFrame:
        try:
            return self.spark.read.schema(SCHEMA).parquet(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], SCHEMA)
            raise

    def _write(self, kind: str, key: str, body: str, deleted: bool) -> None:
        seq = (self._rows().agg(F.max("seq")).first()[0] or 0) + 1
        self.spark.createDataFrame([(kind, key, body, seq, deleted)], SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def put(self, kind: str, key: str, value: object) -> None:
        self._write(kind, key, json.dumps(value, default=str), False)

    def drop(self, kind: str, key: str) -> None:
        self._write(kind, key, "null", True)

    def all(self, kind: str) -> dict[str, object]:
        last = self._rows().where(F.col("kind") == kind).groupBy("key").agg(F.max_by(F.struct("body", "deleted", "seq"), "seq").alias("r")).where("NOT r.deleted")
        return {r["key"]: json.loads(r["body"]) for r in last.select("key", "r.body", "r.seq").orderBy("seq").collect()}

    def get(self, kind: str, key: str) -> object:
        return self.all(kind).get(key)


@dataclass
class MatchConfig:
    source: str
    target: str
    source_key: str
    target_key: str
    rules: list[dict]
    auto: float = 0.9
    review: float = 0.6
    result: str = "crosswalk"
    auto_only: bool = False


def run_match(spark: SparkSession, c: MatchConfig) -> int:
    """Runs a stored match and appends to its crosswalk table; returns the rows added."""
    s, t = spark.table(c.source), spark.table(c.target)
    rules = [linkage.Rule(**r) for r in c.rules]
    m = linkage.match(s, t, c.source_key, c.target_key, rules, c.auto, c.review)
    m = m.where("status = 'auto'") if c.auto_only else m
    label = lambda df, key, cols: df.select(F.col(linkage.resolve_column(df, key)).cast("string").alias("key"), F.concat_ws(" | ", *[F.nullif(F.trim(F.col(linkage.resolve_column(df, x)).cast("string")), F.lit("")) for x in cols]).alias("label"))
    out = linkage.crosswalk(m, label(s, c.source_key, [r.source for r in rules]), label(t, c.target_key, [r.target for r in rules]))
    before = spark.table(c.result).count() if spark.catalog.tableExists(c.result) else 0
    out.write.mode("append").saveAsTable(c.result)
    return spark.table(c.result).count() - before


def save_config(meta: Meta, name: str, c: MatchConfig, cron: str = "") -> None:
    meta.put("match", name, asdict(c) | {"cron": cron, "last": None})


def run_due(meta: Meta, now: datetime, read_only: bool = False) -> dict[str, str]:
    """Runs the stored matches whose schedule fits this minute; nothing in read-only mode."""
    done = {}
    for name, body in meta.all("match").items():
        if read_only or not body["cron"] or not cron_matches(body["cron"], now):
            continue
        c = MatchConfig(**{k: v for k, v in body.items() if k not in ("cron", "last")})
        try:
            done[name] = f"{run_match(meta.spark, c)} rows"
        except Exception as e:  # noqa: BLE001  (recorded with the schedule)
            done[name] = f"failed: {str(e)[:300]}"
        meta.put("match", name, body | {"last": done[name]})
    return done


def save_report(meta: Meta, table: str, geometry: str) -> dict:
    report = geo.quality_report(meta.spark.table(table), geometry).first().asDict()
    meta.put("report", table, report)
    return report


def remember_query(meta: Meta, sql: str) -> None:
    meta.put("query", hashlib.sha256(sql.strip().encode()).hexdigest(), sql.strip())


def recent_queries(meta: Meta, n: int = 20) -> list[str]:
    """The latest different queries, newest first."""
    return list(meta.all("query").values())[::-1][:n]


def log_event(path: str, kind: str, detail: str, verbose: bool = False) -> None:
    """One JSON line; the audit log keeps writes only, the verbose log everything. Secrets are hidden."""
    if verbose or kind != "read_query":
        with open(path, "a", encoding="utf-8") as f:
            f.write(json.dumps({"at": datetime.now().isoformat(timespec="seconds"), "kind": kind, "detail": preview(detail)}) + "\n")
