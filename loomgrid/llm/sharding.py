"""Weighted rendezvous sharding, in DataFrame functions only.

Each record key draws one uniform number per shard from XXH64(key, shard); the shard with the least ``-ln(u) / weight``
wins. A new shard changes nothing between the old ones, so a grown set of shards takes rows only into the new one.

A key is hashed as a string, so its shard does not depend on the width of its type.

Cases: a null key is a key like any other (all null keys share a shard); a null text has size 16 and the CRC of no bytes;
repeated rows get different slots of the same shard, numbered in buckets that follow from the part of the input they are
read from, so rows that repeat without end are not numbered in one task; an empty table gives an empty result; extra
columns are ignored by the query, and kept by ``assign`` and ``slots`` whatever their names, except those they add.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgrid.llm.common import spill, table

N_SHARDS = 40
SLOT_BUCKETS = 256  # slots are counted within so many buckets of each shard; the offsets to broadcast are shards x buckets rows


def draw(key: Column, shard: Column) -> Column:
    """-ln(u) for a uniform u in (0, 1) that the key, as a string, and the shard number decide."""
    bits = F.shiftrightunsigned(F.xxhash64(key.cast("string"), shard.cast("int")), 11)
    return -F.log((bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 53)))


def best_shard(key: Column, weights: list[float]) -> Column:
    """struct(score, shard) of the winner; ties go to the lower shard number."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    return F.array_min(
        F.transform(
            F.sequence(F.lit(0), F.lit(len(weights) - 1)),
            lambda j: F.struct((draw(key, j) / F.get(w, j)).alias("score"), j.alias("shard")),
        )
    )


def assign(df: DataFrame, key: str, weights: list[float], new_weight: float | None = None) -> DataFrame:
    """Adds ``shard`` and, for one more shard of ``new_weight``, ``grown_shard``."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    out = df.withColumn("__best", best_shard(F.col(key), weights))
    n = len(weights)
    shard = F.col("__best.shard").cast("int")
    if new_weight is None:
        return out.withColumn("shard", shard).drop("__best")
    score = draw(F.col(key), F.lit(n)) / F.lit(float(new_weight))
    return out.withColumn("shard", shard).withColumn("grown_shard", F.when(score < F.col("__best.score"), F.lit(n)).otherwise(shard)).drop("__best")


def slots(df: DataFrame, order: list[str], buckets: int = SLOT_BUCKETS) -> DataFrame:
    """Adds ``slot``, gapless from 0 in each shard, without gathering a shard, or the rows of one key, in one task.

    Rows are numbered within (shard, bucket); a bucket starts where the counts of the earlier buckets of its shard end.
    The bucket follows from the row's task and place in it, and is written down before it is used.
    """
    rows = spill(df.withColumn("__bucket", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(buckets)).cast("int")), "slots")
    counts = rows.groupBy("shard", "__bucket").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    within = Window.partitionBy("shard", "__bucket").orderBy(*order)
    numbered = rows.withColumn("__rn", F.row_number().over(within))
    # at most shards x buckets rows, both parameters: a proven bound for the broadcast
    return (
        numbered.join(F.broadcast(starts), ["shard", "__bucket"])
        .withColumn("slot", (F.col("__start") + F.col("__rn") - 1).cast("long"))
        .drop("__bucket", "__start", "__rn")
    )


def op8_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    placed = assign(docs, "doc_id", [1.0] * N_SHARDS, 1.0)
    return slots(placed, ["doc_id", "text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )
