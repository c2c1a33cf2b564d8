"""A small demo dataset for trying the workbench: rows follow from rules, so every run has the same ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "departments": ("id INT, name STRING, region STRING, annual_budget INT", 5),
    "people": ("id INT, name STRING, role STRING, department_id INT, city STRING, hired_on STRING", 10),
    "projects": ("id INT, name STRING, status STRING, owner_id INT, department_id INT, start_date STRING, due_date STRING, budget INT", 8),
    "events": ("id INT, project_id INT, event_type STRING, event_date STRING, amount INT, severity STRING", 20),
    "invoices": ("id INT, project_id INT, customer STRING, invoice_date STRING, status STRING, amount INT", 11),
    "tickets": ("id INT, project_id INT, opened_by INT, priority STRING, status STRING, opened_on STRING, closed_on STRING", 13),
    "customers": ("id INT, name STRING, segment STRING, country STRING, signup_date STRING", 10),
    "products": ("id INT, name STRING, category STRING, unit_price INT", 10),
    "orders": ("id INT, customer_id INT, order_date STRING, channel STRING, status STRING, total_amount INT", 20),
    "order_items": ("id INT, order_id INT, product_id INT, quantity INT, unit_price INT", 26),
    "locations": ("id INT, name STRING, category STRING, lat DOUBLE, lon DOUBLE, geometry STRING", 6),
    "payloads": ("id INT, source STRING, external_id STRING, imported_at STRING, payload_json STRING, payload_xml STRING", 3),
}


def demo(spark: SparkSession, name: str) -> DataFrame:
    """One demo table; ``metrics`` is a series of 30 days and two metrics that dips on weekends."""
    if name == "metrics":
        d = F.explode(F.expr("sequence(DATE '2026-01-01', DATE '2026-01-30', INTERVAL 1 DAY)"))
        days = spark.range(1).select(d.alias("d")).crossJoin(spark.createDataFrame([("visits", 100), ("orders", 20)], "metric string, base int"))
        dip = F.when(F.dayofweek("d").isin(1, 7), 0.6).otherwise(1.0)
        value = F.floor((F.col("base") + F.dayofmonth("d") * 2) * dip).cast("int")
        return days.select(F.expr("row_number() OVER (ORDER BY d, metric)").alias("id"), F.date_format("d", "yyyy-MM-dd").alias("metric_date"), "metric", value.alias("value"))
    schema, n = SCHEMAS[name]
    i = F.col("id")
    special = {
        "lat": 47 + i * 0.9, "lon": 6 + i * 1.1, "external_id": F.lpad(F.col("id").cast("string"), 6, "0"),
        "geometry": F.to_json(F.struct(F.lit("Point").alias("type"), F.array(6 + i * 1.1, 47 + i * 0.9).alias("coordinates"))),
        "payload_json": F.to_json(F.struct(i.alias("n"))), "payload_xml": F.concat(F.lit("<p n=\""), i.cast("string"), F.lit("\"/>")), "imported_at": F.lit("2026-01-01T00:00:00Z"),
    }
    cols = []
    for col in schema.split(", "):
        c, kind = col.split()
        if c == "id":
            v = i
        elif c in special:
            v = special[c]
        elif kind == "INT":
            v = i * 7 % 5 + 1 if c.endswith("_id") or c == "opened_by" else i * 250 % 4000 + 100
        elif c.endswith(("_date", "_on")):
            v = F.date_format(F.date_add(F.lit("2026-01-01").cast("date"), (i * 3).cast("int")), "yyyy-MM-dd")
        else:
            v = F.concat(F.lit(f"{c} "), (i % 4).cast("string")) if c != "name" else F.concat(F.lit(f"{name[:-1]} "), i.cast("string"))
        cols.append(v.cast(kind).alias(c))
    return spark.range(1, n + 1).select(F.col("id").cast("int").alias("id")).select(*cols)
