"""Exact cosine search and incremental maintenance of an embedding table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Similarity of two numeric arrays; null if a norm is zero."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def parse_vector(c: Column) -> Column:
    return F.from_json(c, "array<double>")


def top_k(df: DataFrame, vector: str, query: list[float], k: int, where: Column | None = None, order: str | None = None) -> DataFrame:
    """The k nearest rows with _vec_distance and _vec_rank. Predicates apply before ranking, so k rows are found if there are k."""
    rows = df if where is None else df.where(where)
    score = cosine(F.col(vector), F.array(*[F.lit(float(x)) for x in query]))
    # sorted and cut by TakeOrderedAndProject: each task keeps k rows
    best = rows.withColumn("_vec_distance", 1 - score).where(F.col("_vec_distance").isNotNull()).orderBy("_vec_distance", *([order] if order else [])).limit(k)
    return best.withColumn("_vec_rank", F.row_number().over(Window.orderBy("_vec_distance", *([order] if order else []))))  # k rows


def refresh(index: DataFrame, objects: DataFrame, model: str, embed: Callable[[list[str]], list[list[float]]], batch: int = 16) -> tuple[DataFrame, DataFrame]:
    """(the new index, a report): unchanged objects keep their vectors, changed and new ones are embedded in batches, vanished ones go.

    ``objects`` has name and definition, ``index`` has name, model, hash and embedding.
    """
    now = objects.select("name", "definition", F.sha2(F.concat_ws("\n", F.lit(model), "definition"), 256).alias("hash"))
    own = index.where(F.col("model") == model)
    same = own.join(now.select("name", "hash"), ["name", "hash"], "left_semi")
    todo = now.join(own.select("name", "hash"), ["name", "hash"], "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, batch):
                part = b.slice(a, batch)
                vectors = embed(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([model] * part.num_rows), part.column(2), pa.array(vectors, pa.list_(pa.float64()))], ["name", "model", "hash", "embedding"])

    made = todo.mapInArrow(run, "name string, model string, hash string, embedding array<double>")
    other = index.where(F.col("model") != model)
    gone = own.join(now.select("name"), "name", "left_anti")
    report = same.agg(F.count("*").alias("unchanged")).crossJoin(todo.agg(F.count("*").alias("embedded"))).crossJoin(gone.agg(F.count("*").alias("removed")))
    return other.unionByName(same).unionByName(made), report


def register_functions(spark: SparkSession) -> None:
    """vec_from_json and vec_cosine_similarity for SQL text, defined in SQL so that Catalyst sees through them."""
    norm = "sqrt(aggregate({0}, 0D, (s, x) -> s + x * x))"
    product = "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION vec_from_json(v STRING) RETURNS ARRAY<DOUBLE> RETURN from_json(v, 'array<double>')")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION vec_cosine_similarity(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE "
        f"RETURN {product} / nullif({norm.format('a')} * {norm.format('b')}, 0D)"
    )
