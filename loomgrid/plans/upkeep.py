"""Queries over catalogs of objects, tiles, stored matches, fixed-width lines and event time, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgrid.functions import fixedwidth
from loomgrid.operators import linkage
from loomgrid.plans.workbench import _NAMES, _names
from loomgrid.session import table
from loomgrid.sinks.writers import tile


def match_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Sources that no target reached, by anti-join."""
    a, b = _names(spark, d)
    m = linkage.match(a, b, "id", "kdnr", [linkage.Rule("name", "firma", "token_set")], review=0.5)
    return a.select(F.col("id").cast("string").alias("source_key")).join(m, "source_key", "left_anti")


def crosswalk_labels(spark: SparkSession, d: str) -> DataFrame:
    """The stored form of a match; a blank label falls back to the key."""
    a, b = _names(spark, d)
    m = linkage.match(a, b, "id", "kdnr", [linkage.Rule("name", "firma", "token_set")], auto=0.8, review=0.5, max_candidates=1).where("status = 'auto'")
    source = a.select(F.col("id").cast("string").alias("key"), F.when(F.col("id") % 3 == 0, " ").otherwise(F.col("name")).alias("label"))
    target = b.select(F.col("kdnr").cast("string").alias("key"), F.col("firma").alias("label"))
    return linkage.crosswalk(m, source, target).select("source_key", "source_label", "target_key", "target_label", F.round("score", 6).alias("score"))


def stale_objects(spark: SparkSession, d: str) -> DataFrame:
    """Index entries whose object is gone."""
    index = table(spark, d, "supplier").select(F.col("s_suppkey").alias("object"))
    now = table(spark, d, "lineitem").where("l_quantity > 49 AND l_tax > 0.07").select(F.col("l_suppkey").alias("object"))
    return index.join(now, "object", "left_anti")


def semi_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges whose two ends are both known, by two semi-joins."""
    o = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"))
    nodes = table(spark, d, "supplier").where("s_acctbal > 0").select("s_suppkey")
    kept = o.join(nodes.select(F.col("s_suppkey").alias("src")), "src", "left_semi").join(nodes.select(F.col("s_suppkey").alias("dst")), "dst", "left_semi")
    return kept.groupBy("src", "dst").agg(F.count("*").alias("n"))


def sha_dedup(spark: SparkSession, d: str) -> DataFrame:
    """One row per distinct text: its digest, least id and number of copies. Only digests are shuffled."""
    docs = table(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    return docs.groupBy("sha256").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


def lineage_digest(spark: SparkSession, d: str) -> DataFrame:
    """Definitions of a bundle that are not stored yet, by digest."""
    digest = F.sha2(F.concat_ws("|", "p_name", "p_brand").cast("binary"), 256)
    p = table(spark, d, "part").select("p_partkey", digest.alias("digest"))
    stored = p.where("p_partkey % 3 = 0").select("digest")
    return p.join(stored, "digest", "left_anti")


def fixed_width(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    line = F.concat(F.lpad(F.col("n_nationkey").cast("string"), 4, " "), F.lit("  "), F.rpad("n_name", 30, " "), F.lit(" "), F.col("n_regionkey").cast("string"))
    lines = n.select(line.alias("value"))
    return fixedwidth.split_fields(lines, fixedwidth.field_spans(lines))


def tile_lookup_tms(spark: SparkSession, d: str) -> DataFrame:
    """A tile by XYZ address in a layer that counts rows from the south."""
    p = table(spark, d, "part")
    text = lambda c: F.col(c).cast("string")
    tiles = p.select(
        F.lit("tile").alias("record_type"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("value"), F.lit("20").alias("zoom_level"), text("p_partkey").alias("tile_column"),
        (F.lit((1 << 20) - 1) - F.col("p_partkey") * 3).cast("string").alias("tile_row"), F.sha2(F.col("p_name").cast("binary"), 256).alias("tile_sha256"), F.base64(F.col("p_name").cast("binary")).alias("tile_data_base64"),
    )
    return tile(tiles, 20, 7, 21).select(F.decode("data", "utf-8").alias("data"), "tile_sha256")


def latest_versions(spark: SparkSession, d: str) -> DataFrame:
    """The latest row of each key, in one aggregation."""
    o = table(spark, d, "orders")
    last = o.groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey", "o_orderstatus")).alias("m"), F.count("*").alias("versions"))
    return last.select("o_custkey", F.col("m.o_orderkey").alias("o_orderkey"), F.col("m.o_orderstatus").alias("o_orderstatus"), "versions")


def ranked_orders(spark: SparkSession, d: str) -> DataFrame:
    """Window functions: the three largest orders of a customer, each with its distance to the next larger one."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    ranked = o.withColumn("rank", F.row_number().over(w)).where("rank <= 3")  # pruned per task before the shuffle
    return ranked.select("o_custkey", "o_orderkey", F.col("rank").cast("long").alias("rank"), F.round(F.lag("o_totalprice").over(w) - F.col("o_totalprice"), 2).alias("gap"))


def cube_totals(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.grouping_id().cast("long").alias("level"))


def event_hours(spark: SparkSession, d: str) -> DataFrame:
    """Tumbling event-time windows."""
    e = table(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return e.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", "total")


def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Session windows with a gap of 30 minutes."""
    s = table(spark, d, "events").groupBy(F.session_window("ts", "30 minutes").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


QUERIES = {
    f.__name__: f
    for f in (
        match_unmatched, crosswalk_labels, stale_objects, semi_edges, sha_dedup, lineage_digest, fixed_width, tile_lookup_tms, latest_versions, ranked_orders, cube_totals,
        event_hours, event_sessions,
    )
}

ORACLES = {
    "match_unmatched": f"WITH {_NAMES} SELECT s AS source_key FROM a WHERE s NOT IN (SELECT s FROM pairs WHERE j >= 0.5)",
    "crosswalk_labels": f"""WITH {_NAMES}, k AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY j DESC, t) AS rk FROM pairs WHERE j >= 0.8)
        SELECT s AS source_key, CASE WHEN CAST(s AS BIGINT) % 3 = 0 THEN s ELSE a.name END AS source_label, t AS target_key, b.firma AS target_label, round(j, 6) AS score
        FROM k JOIN a USING (s) JOIN b USING (t) WHERE rk = 1""",
    "stale_objects": "SELECT s_suppkey AS object FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49 AND l_tax > 0.07 AND l_suppkey IS NOT NULL)",
    "semi_edges": """WITH n AS (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) SELECT l_suppkey AS src, l_partkey AS dst, count(*) AS n FROM lineitem
        WHERE l_suppkey IN (FROM n) AND l_partkey IN (FROM n) GROUP BY 1, 2""",
    "sha_dedup": "SELECT sha256(text) AS sha256, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1",
    "lineage_digest": """WITH p AS (SELECT p_partkey, sha256(concat_ws('|', p_name, p_brand)) AS digest FROM part)
        SELECT p_partkey, digest FROM p WHERE digest NOT IN (SELECT digest FROM p WHERE p_partkey % 3 = 0)""",
    "fixed_width": "SELECT CAST(n_nationkey AS VARCHAR) AS col_1, n_name AS col_2, CAST(n_regionkey AS VARCHAR) AS col_3 FROM nation",
    "tile_lookup_tms": "SELECT p_name AS data, sha256(p_name) AS tile_sha256 FROM part WHERE p_partkey = 7",
    "latest_versions": """SELECT o_custkey, o_orderkey, o_orderstatus, versions FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS versions,
        row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""",
    "ranked_orders": """SELECT o_custkey, o_orderkey, row_number() OVER w AS rank, round(lag(o_totalprice) OVER w - o_totalprice, 2) AS gap FROM orders
        WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) QUALIFY rank <= 3""",
    "cube_totals": """SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total, CAST(grouping_id(o_orderstatus, o_orderpriority) AS BIGINT) AS level
        FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""",
    "event_hours": """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2""",
    "event_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM g), c AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY 1, 2)
        SELECT user_id, count(*) AS sessions, max(n) AS longest FROM c GROUP BY 1""",
}
