"""Relational queries a user of the workbench runs every day, as DataFrame plans with a SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.session import table


def revenue_by_customer(spark: SparkSession, d: str) -> DataFrame:
    """Inner equi-join, group, sum, order: order value per customer name."""
    orders = table(spark, d, "orders").select("o_custkey", "o_totalprice")
    per_key = orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("revenue"), F.count("*").alias("n_orders"))
    customer = table(spark, d, "customer").select("c_custkey", "c_name")
    return (
        customer.join(per_key, customer.c_custkey == per_key.o_custkey)
        .select("c_custkey", "c_name", F.round("revenue", 2).alias("revenue"), "n_orders")
        .orderBy(F.desc("revenue"), "c_custkey")
    )


def orders_by_status(spark: SparkSession, d: str) -> DataFrame:
    return (
        table(spark, d, "orders")
        .groupBy("o_orderstatus")
        .agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
        .orderBy("o_orderstatus")
    )


def best_sellers(spark: SparkSession, d: str) -> DataFrame:
    """Aggregated by key before the join, so the join moves one row per part."""
    per_part = (
        table(spark, d, "lineitem")
        .groupBy("l_partkey")
        .agg(F.sum("l_quantity").alias("units"), F.sum(F.expr("l_extendedprice * (1 - l_discount)")).alias("revenue"))
    )
    part = table(spark, d, "part").select("p_partkey", "p_name", "p_brand")
    return (
        part.join(per_part, part.p_partkey == per_part.l_partkey)
        .select("p_partkey", "p_name", "p_brand", "units", F.round("revenue", 2).alias("revenue"))
        .orderBy(F.desc("units"), "p_partkey")
        .limit(50)
    )


def open_by_priority(spark: SparkSession, d: str) -> DataFrame:
    return (
        table(spark, d, "orders")
        .where("o_orderstatus <> 'F' AND o_orderpriority NOT LIKE '5%'")
        .groupBy("o_orderpriority")
        .agg(F.count("*").alias("n_open"))
        .orderBy("o_orderpriority")
    )


def budget_by_segment(spark: SparkSession, d: str) -> DataFrame:
    """A chain of dimension joins over pre-aggregated customers."""
    cust = (
        table(spark, d, "customer")
        .groupBy("c_nationkey", "c_mktsegment")
        .agg(F.sum("c_acctbal").alias("bal"), F.count("*").alias("n"))
    )
    nation = table(spark, d, "nation")
    region = table(spark, d, "region")
    return (
        cust.join(nation, cust.c_nationkey == nation.n_nationkey)
        .join(region, nation.n_regionkey == region.r_regionkey)
        .groupBy("r_name", "c_mktsegment")
        .agg(F.round(F.sum("bal"), 2).alias("balance"), F.sum("n").alias("n_customers"))
        .orderBy("r_name", "c_mktsegment")
    )


def suppliers_left(spark: SparkSession, d: str) -> DataFrame:
    """LEFT JOIN with an expression projection, CASE and concatenation."""
    n = table(spark, d, "nation")
    s = table(spark, d, "supplier").where("s_acctbal > 0")
    cnt = s.groupBy("s_nationkey").agg(F.count("*").alias("k"))
    return n.join(cnt, n.n_nationkey == cnt.s_nationkey, "left").select(
        F.concat_ws("/", F.col("n_nationkey").cast("string"), "n_name").alias("label"),
        F.coalesce("k", F.lit(0)).alias("n_suppliers"),
        F.expr("CASE WHEN k IS NULL THEN 'none' WHEN k > 3 THEN 'many' ELSE 'some' END").alias("band"),
    )


def page_sorted(spark: SparkSession, d: str, limit: int = 50, offset: int = 100) -> DataFrame:
    """ORDER BY with LIMIT and OFFSET over a total order."""
    return (
        table(spark, d, "orders")
        .select("o_orderkey", "o_totalprice", "o_orderstatus")
        .orderBy(F.desc("o_totalprice"), "o_orderkey")
        .offset(offset)
        .limit(limit)
    )


def union_missing_columns(spark: SparkSession, d: str) -> DataFrame:
    """Union by name, absent columns null, with the source table kept as a column."""
    c = table(spark, d, "customer").select(F.lit("customer").alias("source_table"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, d, "supplier").select(F.lit("supplier").alias("source_table"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("acctbal"))
    return c.unionByName(s, allowMissingColumns=True)


def set_operations(spark: SparkSession, d: str) -> DataFrame:
    cust = table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).where("c_nationkey < 20")
    supp = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")).where("s_nationkey > 5")
    tag = lambda df, name: df.select(F.lit(name).alias("op"), "k")
    return tag(cust.intersect(supp), "intersect").unionAll(tag(cust.subtract(supp), "except")).unionAll(tag(cust.union(supp).distinct(), "union"))


def distinct_options(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.lower("c_mktsegment").alias("option")).distinct().orderBy("option")


def semi_anti(spark: SparkSession, d: str) -> DataFrame:
    """Customers with and without orders, by semi and anti join."""
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    yes = c.join(o, "c_custkey", "left_semi").groupBy("c_mktsegment").agg(F.count("*").alias("n")).withColumn("kind", F.lit("with"))
    no = c.join(o, "c_custkey", "left_anti").groupBy("c_mktsegment").agg(F.count("*").alias("n")).withColumn("kind", F.lit("without"))
    return yes.unionByName(no)


def scalar_totals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").agg(
        F.count("*").alias("n"), F.max("o_orderkey").alias("max_id"), F.round(F.sum("o_totalprice"), 2).alias("total")
    )


def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    """Scan-heavy grouped aggregate with a pushed date filter."""
    return (
        table(spark, d, "lineitem")
        .where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
            F.round(F.sum(F.expr("l_extendedprice * (1 - l_discount)")), 2).alias("sum_disc"),
            F.round(F.avg("l_discount"), 6).alias("avg_disc"),
            F.count("*").alias("n"),
        )
    )


QUERIES = {
    f.__name__: f
    for f in (
        revenue_by_customer, orders_by_status, best_sellers, open_by_priority, budget_by_segment, suppliers_left,
        page_sorted, union_missing_columns, set_operations, distinct_options, semi_anti, scalar_totals, pricing_summary,
    )
}

ORACLES = {
    "revenue_by_customer": """SELECT c_custkey, c_name, round(sum(o_totalprice), 2) AS revenue, count(*) AS n_orders
        FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_name ORDER BY revenue DESC, c_custkey""",
    "orders_by_status": """SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1 ORDER BY 1""",
    "best_sellers": """SELECT p_partkey, p_name, p_brand, sum(l_quantity) AS units, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3 ORDER BY units DESC, p_partkey LIMIT 50""",
    "open_by_priority": """SELECT o_orderpriority, count(*) AS n_open FROM orders
        WHERE o_orderstatus <> 'F' AND o_orderpriority NOT LIKE '5%' GROUP BY 1 ORDER BY 1""",
    "budget_by_segment": """SELECT r_name, c_mktsegment, round(sum(c_acctbal), 2) AS balance, count(*) AS n_customers
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""",
    "suppliers_left": """SELECT n_nationkey || '/' || n_name AS label, coalesce(k, 0) AS n_suppliers,
        CASE WHEN k IS NULL THEN 'none' WHEN k > 3 THEN 'many' ELSE 'some' END AS band
        FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS k FROM supplier WHERE s_acctbal > 0 GROUP BY 1) ON n_nationkey = s_nationkey""",
    "page_sorted": """SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100""",
    "union_missing_columns": """SELECT 'customer' AS source_table, c_name AS name, c_mktsegment AS segment, NULL::DOUBLE AS acctbal FROM customer
        UNION ALL SELECT 'supplier', s_name, NULL, s_acctbal FROM supplier""",
    "set_operations": """WITH c AS (SELECT c_nationkey AS k FROM customer WHERE c_nationkey < 20), s AS (SELECT s_nationkey AS k FROM supplier WHERE s_nationkey > 5)
        SELECT 'intersect' AS op, k FROM (SELECT k FROM c INTERSECT SELECT k FROM s)
        UNION ALL SELECT 'except', k FROM (SELECT k FROM c EXCEPT SELECT k FROM s)
        UNION ALL SELECT 'union', k FROM (SELECT k FROM c UNION SELECT k FROM s)""",
    "distinct_options": """SELECT DISTINCT lower(c_mktsegment) AS option FROM customer""",
    "semi_anti": """SELECT c_mktsegment, count(*) AS n, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'with' ELSE 'without' END AS kind
        FROM customer GROUP BY 1, 3""",
    "scalar_totals": """SELECT count(*) AS n, max(o_orderkey) AS max_id, round(sum(o_totalprice), 2) AS total FROM orders""",
    "pricing_summary": """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc,
        round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""",
}
