"""Queries over markup, JSON, result windows and migration types, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.functions import markup, text
from loomgrid.operators import sqlgate
from loomgrid.session import table
from loomgrid.sinks.writers import excel_cell


def html_tables(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    page = F.concat(F.lit("<html><table class='x'><tr><th>k</th><th>n</th></tr><tr><td>"), F.col("n_nationkey").cast("string"), F.lit("</td><td><b>"), F.col("n_name"), F.lit("</b><br/>&amp;</td></tr></table></html>"))
    rows = markup.html_table_rows(n.select("n_nationkey", page.alias("html")), "html", ["n_nationkey"])
    return rows.select("n_nationkey", "table_index", "row_index", F.get("cells", 0).alias("col_1"), F.get("cells", 1).alias("col_2"))


def json_props(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.floor(markup.json_number(F.col("props"), "k") / 10).cast("long").alias("bucket"), "value")
    return e.groupBy("bucket").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


def nested_text(spark: SparkSession, d: str) -> DataFrame:
    merged = markup.json_merge(F.col("props"), F.concat(F.lit('{"user":"'), F.col("user_id").cast("string"), F.lit('"}')))
    return table(spark, d, "events").select("event_id", F.try_element_at(merged, F.lit("user")).alias("user"), F.size(merged).cast("long").alias("n_keys"))


def window_has_more(spark: SparkSession, d: str) -> DataFrame:
    table(spark, d, "orders").createOrReplaceTempView("loomgrid_orders")
    w = sqlgate.run_window(spark, "SELECT o_orderkey FROM loomgrid_orders ORDER BY o_orderkey", 40, 60)
    return spark.createDataFrame([(len(w.rows), w.rows[0][0], w.rows[-1][0], w.has_more)], "n long, first long, last long, has_more boolean")


def schema_probe(spark: SparkSession, d: str) -> DataFrame:
    fields = table(spark, d, "orders").limit(0).schema.fields
    return spark.createDataFrame([(i, f.name) for i, f in enumerate(fields)], "position long, name string")


def record_by_id(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").where(F.col("c_custkey") == 42)


def excel_cells(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    v = F.when(F.col("p_partkey") % 3 == 0, F.lpad(F.col("p_partkey").cast("string"), 8, "0")).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("="), F.col("p_partkey").cast("string"))).otherwise(F.col("p_partkey").cast("string"))
    return p.select("p_partkey", excel_cell(v).alias("cell"))


def excel_serials(spark: SparkSession, d: str) -> DataFrame:
    days = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1899-12-30").cast("date"))
    return table(spark, d, "orders").select("o_orderkey", days.cast("long").alias("serial"))


def redacted(spark: SparkSession, d: str) -> DataFrame:
    s = F.concat(F.lit("login user="), F.col("c_custkey").cast("string"), F.lit(" Password: p"), F.col("c_custkey").cast("string"), F.lit(", token=t1"))
    return table(spark, d, "customer").select("c_custkey", text.redact(s).alias("line"))


def migration_types(spark: SparkSession, d: str) -> DataFrame:
    names = ("INT", "BIGINT", "REAL", "DOUBLE PRECISION", "NUMERIC(10,2)", "BOOLEAN", "BIT", "VARCHAR(10)", "POINT")
    return spark.createDataFrame([(n, sqlgate.type_class(n), sqlgate.target_type(n, "postgres")) for n in names], "source string, class string, target string")


QUERIES = {f.__name__: f for f in (html_tables, json_props, nested_text, window_has_more, schema_probe, record_by_id, excel_cells, excel_serials, redacted, migration_types)}

ORACLES = {
    "html_tables": """SELECT n_nationkey, 1 AS table_index, 1 AS row_index, 'k' AS col_1, 'n' AS col_2 FROM nation
        UNION ALL SELECT n_nationkey, 1, 2, CAST(n_nationkey AS VARCHAR), n_name || chr(10) || '&' FROM nation""",
    "json_props": """SELECT CAST(floor(CAST(json_extract_string(props, '$.k') AS DOUBLE) / 10) AS BIGINT) AS bucket, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1""",
    "nested_text": """SELECT event_id, CAST(user_id AS VARCHAR) AS "user", CAST(len(json_keys(props)) + 1 AS BIGINT) AS n_keys FROM events""",
    "window_has_more": """WITH w AS (SELECT o_orderkey FROM orders ORDER BY 1 LIMIT 60 OFFSET 40) SELECT count(*) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last, (SELECT count(*) > 100 FROM orders) AS has_more FROM w""",
    "schema_probe": "SELECT CAST(column_index - 1 AS BIGINT) AS position, column_name AS name FROM duckdb_columns() WHERE table_name = 'orders'",
    "record_by_id": "SELECT * FROM customer WHERE c_custkey = 42",
    "excel_cells": """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '"=""' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') || repeat('"', 3) WHEN 1 THEN '"=""=' || p_partkey || repeat('"', 3)
        ELSE CAST(p_partkey AS VARCHAR) END AS cell FROM part""",
    "excel_serials": "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) - DATE '1899-12-30' AS BIGINT) AS serial FROM orders",
    "redacted": "SELECT c_custkey, 'login user=' || c_custkey || ' Password: [REDACTED], token=[REDACTED]' AS line FROM customer",
    "migration_types": """SELECT * FROM (VALUES ('INT', 'int', 'BIGINT'), ('BIGINT', 'int', 'BIGINT'), ('REAL', 'float', 'DOUBLE PRECISION'), ('DOUBLE PRECISION', 'float', 'DOUBLE PRECISION'),
        ('NUMERIC(10,2)', 'float', 'DOUBLE PRECISION'), ('BOOLEAN', 'bool', 'BOOLEAN'), ('BIT', 'bool', 'BOOLEAN'), ('VARCHAR(10)', 'text', 'TEXT'), ('POINT', 'int', 'BIGINT')) t(source, "class", target)""",
}
