"""Helpers shared by the training-data operators: inputs and tables kept in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Collection

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master, where all run on one machine,
    may leave it unset and gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='loomgrid-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _folder(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def at_exit(spark: SparkSession, path: str) -> None:
    """Delete a folder when the application ends, if nothing has deleted it before."""
    p, fs = _folder(spark, path)
    fs.deleteOnExit(p)


def spill(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage with a written table: it survives lost executors, and later reads do not recompute ``df``.

    The table is deleted by ``drop`` as soon as no result reads it any more, or at the end of the application.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._spill_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete spilled tables that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_spill_path", None):
            p, fs = _folder(df.sparkSession, path)
            fs.delete(p, True)


def sheltered(df: DataFrame, used: Collection[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``df`` with its columns, except the ``used`` ones, under names that no operator takes for itself, and the way back to
    exactly the columns of ``df``."""
    names, inner = df.columns, [c if c in used else f"__in_{i}" for i, c in enumerate(df.columns)]
    return df.toDF(*inner), lambda out: out.select(*inner).toDF(*names)


def parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def null_safe(left: DataFrame, right: DataFrame, keys: Collection[str], how: str) -> DataFrame:
    """A join on ``keys`` of equal names in which null equals null; a full join has the keys of either side once."""
    other = right.select(*[F.col(c).alias(f"__r_{c}" if c in keys else c) for c in right.columns])
    on: Column = F.lit(True)
    for c in keys:
        on = on & F.col(c).eqNullSafe(F.col(f"__r_{c}"))
    out = left.join(other, on, how)
    if how in ("left_semi", "left_anti"):
        return out
    rest = [c for c in [*left.columns, *right.columns] if c not in keys]
    return out.select(*[F.coalesce(c, f"__r_{c}").alias(c) for c in keys], *rest)
