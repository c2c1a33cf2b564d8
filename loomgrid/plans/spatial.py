"""Queries over geometries, vectors and routing graphs derived from the test tables, with their SQL twins."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.operators import geo, routing, vectors
from loomgrid.session import table


def _places(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, d, "customer").select("c_custkey", "c_mktsegment", (k * 37 % 3600 / 10 - 180).alias("lon"), (k * 17 % 1800 / 10 - 90).alias("lat"))


def haversine_pairs(spark: SparkSession, d: str) -> DataFrame:
    p = _places(spark, d)
    return p.select("c_custkey", F.round(geo.haversine_m(F.col("lon"), F.col("lat"), F.lit(13.4), F.lit(52.5)), 1).alias("meters"))


def nearest_node(spark: SparkSession, d: str) -> DataFrame:
    n = _places(spark, d).select(F.col("c_custkey").cast("string").alias("id"), "lon", "lat")
    return routing.nearest_node(n, 13.4, 52.5).withColumn("meters", F.round("meters", 1))


def bbox_filter(spark: SparkSession, d: str) -> DataFrame:
    p = _places(spark, d)
    line = F.concat(F.lit('{"type":"LineString","coordinates":[['), "lon", F.lit(","), "lat", F.lit("],["), F.col("lon") + 2, F.lit(","), F.col("lat") + 1, F.lit("]]}"))
    return p.withColumn("g", line).where(geo.meets_bbox(F.col("g"), (-10.0, -10.0, 20.0, 20.0))).select("c_custkey")


def geo_sql(spark: SparkSession, d: str) -> DataFrame:
    geo.register_functions(spark)
    _places(spark, d).createOrReplaceTempView("loomgrid_places")
    return spark.sql("""SELECT c_custkey, round(geo_distance(geo_point(lon, lat), geo_point(13.4D, 52.5D)), 1) AS meters,
        geo_dwithin(geo_point(lon, lat), geo_point(13.4D, 52.5D), 500000D) AS near FROM loomgrid_places WHERE geo_within_bbox(geo_point(lon, lat), 5D, 45D, 25D, 60D)""")


def lonlat_features(spark: SparkSession, d: str) -> DataFrame:
    f = geo.to_features(_places(spark, d).withColumn("lat", F.when(F.col("c_custkey") % 5 == 0, F.lit(99.0)).otherwise(F.col("lat"))))
    return f.groupBy(F.get_json_object("properties", "$.c_mktsegment").alias("segment")).agg(F.count("*").alias("n"), F.round(F.max(geo.bbox(F.col("geometry")).max_x), 3).alias("east"))


def geo_summary(spark: SparkSession, d: str) -> DataFrame:
    p = _places(spark, d)
    g = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit('{"type":"MultiPoint","coordinates":[['), "lon", F.lit(","), "lat", F.lit("],[0,0]]}"))).otherwise(geo.point_json(F.col("lon"), F.col("lat")))
    return geo.summary(p.withColumn("g", g), "g")


def quality_report(spark: SparkSession, d: str) -> DataFrame:
    p = _places(spark, d)
    g = F.when(F.col("c_custkey") % 11 == 0, None).when(F.col("c_custkey") % 7 == 0, geo.point_json(F.lit(230.0), F.col("lat"))).otherwise(geo.point_json(F.col("lon"), F.col("lat")))
    return geo.quality_report(p.withColumn("g", g), "g")


def explode_multi(spark: SparkSession, d: str) -> DataFrame:
    p = _places(spark, d)
    g = F.concat(F.lit('{"type":"GeometryCollection","geometries":[{"type":"MultiPoint","coordinates":[[1,2],['), "lon", F.lit(","), "lat", F.lit(']]},{"type":"LineString","coordinates":[[0,0],[1,1]]}]}'))
    out = geo.explode_parts(p.select("c_custkey", g.alias("g")), "g")
    return out.groupBy(geo.geometry_type(F.col("g")).alias("t")).agg(F.count("*").alias("n"), F.countDistinct("c_custkey").alias("features"))


def _tracks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("user_id", "ts", "event_id", (F.col("event_id") % 360 - 180).cast("double").alias("x"), (F.col("value") % 90).alias("y")).where("value IS NOT NULL")


def simplify_lines(spark: SparkSession, d: str) -> DataFrame:
    line = _tracks(spark, d).groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "x", "y"))).alias("p")).where(F.size("p") >= 2)
    g = F.to_json(F.struct(F.lit("LineString").alias("type"), F.transform("p", lambda p: F.array(p["x"], p["y"])).alias("coordinates")))
    out = line.select("user_id", F.size("p").alias("before"), geo.simplify(g, 5.0).alias("g"))
    return out.select("user_id", "before", F.size(geo.xs(F.col("g"))).alias("after"))


def convex_hulls(spark: SparkSession, d: str) -> DataFrame:
    return geo.convex_hulls(_tracks(spark, d), "user_id", "x", "y")


def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    q = e.where("vec_id = 0").first()["embedding"]
    out = vectors.top_k(e.where("vec_id <> 0"), "embedding", q, 20, order="vec_id")
    return out.select("vec_id", F.round("_vec_distance", 6).alias("distance"), F.col("_vec_rank").cast("long").alias("rank"))


def _fake(texts: list[str]) -> list[list[float]]:
    return [[float(len(t)), float(len(t) % 7)] for t in texts]


def incremental_index(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    before = n.where("n_nationkey < 20").select(F.col("n_name").alias("name"), F.lit("m").alias("model"), F.sha2(F.concat_ws("\n", F.lit("m"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise("old")), 256).alias("hash"), F.array(F.lit(0.0)).alias("embedding"))
    now = n.where("n_nationkey >= 5").select(F.col("n_name").alias("name"), F.col("n_name").alias("definition"))
    index, report = vectors.refresh(before, now, "m", _fake)
    return index.agg(F.count("*").alias("objects"), F.count_if(F.size("embedding") == 2).alias("fresh")).crossJoin(report)


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    return routing.nodes_of(table(spark, d, "supplier").select(k.cast("string").alias("id"), (k % 36).cast("double").alias("lon"), (k % 17).cast("double").alias("lat")))


def _graph(spark: SparkSession, d: str) -> DataFrame:
    """All suppliers as nodes with three edges each; the ends wrap around at the number of suppliers."""
    s = table(spark, d, "supplier")
    k, m = F.col("s_suppkey"), F.lit(max(1, s.count()))
    edges = s.select(k.cast("string").alias("from"), F.explode(F.array(k % m + 1, k * 7 % m + 1, k * 13 % m + 1).cast("array<string>")).alias("to"), (k % 9 + 1).cast("double").alias("weight"))
    return routing.edges_of(edges, _nodes(spark, d), "cost")


def shortest_paths(spark: SparkSession, d: str) -> DataFrame:
    return routing.shortest(_graph(spark, d), "1").select("id", "cost")


def reachable(spark: SparkSession, d: str) -> DataFrame:
    return routing.reachable(_graph(spark, d), "1", 12.0)


def reachable_features(spark: SparkSession, d: str) -> DataFrame:
    """The reachable nodes on a map: what geometries there are, and the cost of the nodes."""
    f = routing.reachable_features(_nodes(spark, d), routing.shortest(_graph(spark, d), "1", 12.0), 12.0)
    kind = geo.geometry_type(F.col("geometry")).alias("kind")
    return f.groupBy(kind).agg(F.count("*").alias("n"), F.sum(F.get_json_object("properties", "$.cost").cast("double")).alias("cost"))


def view_bounds(spark: SparkSession, d: str) -> DataFrame:
    """The map box of all places, and of those on one parallel, which is widened."""
    p = _places(spark, d).select(geo.point_json(F.col("lon"), F.col("lat")).alias("g"), geo.point_json(F.col("lon"), F.lit(7.0)).alias("h"))
    return geo.view_bounds(p, "g").unionAll(geo.view_bounds(p, "h"))


def route_answer(spark: SparkSession, d: str) -> DataFrame:
    """The cheapest way to node 50: its cost, and whether its line and list of nodes fit its number of edges."""
    r = routing.route(_nodes(spark, d), _graph(spark, d), "1", "50")
    last = F.element_at("node_ids", -1).alias("goal")
    return r.select("cost", (F.size("node_ids") == F.col("edge_count") + 1).alias("whole"), last, (F.size(geo.xs(F.col("geometry"))) <= F.size("node_ids")).alias("line"), (F.col("distance_meters") >= 0).alias("measured"))


def route_path(spark: SparkSession, d: str) -> DataFrame:
    way = routing.path(routing.shortest(_graph(spark, d), "1"), "50")
    return spark.createDataFrame([(len(way) - 1, way[-1][1], json.dumps([way[0][0], way[-1][0]]))], "edges long, cost double, ends string")


QUERIES = {
    f.__name__: f
    for f in (
        haversine_pairs, nearest_node, bbox_filter, geo_sql, lonlat_features, geo_summary, quality_report, explode_multi, simplify_lines, convex_hulls,
        cosine_topk, incremental_index, shortest_paths, reachable, reachable_features, route_answer, view_bounds, route_path,
    )
}

_P = "p AS (SELECT c_custkey, c_mktsegment, c_custkey * 37 % 3600 / 10 - 180 AS lon, c_custkey * 17 % 1800 / 10 - 90 AS lat FROM customer)"
_M = "2 * 6371008.8 * atan2(sqrt(h), sqrt(1 - h))"
_H = "h AS (SELECT *, pow(sin(radians(52.5 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(52.5)) * pow(sin(radians(13.4 - lon) / 2), 2) AS h FROM p)"
_G = """m AS (SELECT count(*) AS m FROM supplier),
e AS (SELECT s_suppkey AS src, unnest([s_suppkey % m + 1, s_suppkey * 7 % m + 1, s_suppkey * 13 % m + 1]) AS dst, CAST(s_suppkey % 9 + 1 AS DOUBLE) AS w FROM supplier, m),
known AS (SELECT e.* FROM e WHERE dst IN (SELECT s_suppkey FROM supplier)),
r(id, cost) USING KEY (id) AS (SELECT 1::BIGINT, 0.0::DOUBLE UNION SELECT id, min(cost) FROM (SELECT k.dst AS id, r.cost + k.w AS cost FROM r JOIN known k ON r.id = k.src) n
  WHERE NOT EXISTS (SELECT 1 FROM recurring.r o WHERE o.id = n.id AND o.cost <= n.cost) GROUP BY id)"""
ORACLES = {
    "haversine_pairs": f"WITH {_P}, {_H} SELECT c_custkey, round({_M}, 1) AS meters FROM h",
    "nearest_node": f"WITH {_P}, {_H} SELECT CAST(c_custkey AS VARCHAR) AS id, round({_M}, 1) AS meters FROM h ORDER BY {_M}, 1 LIMIT 1",
    "bbox_filter": f"WITH {_P} SELECT c_custkey FROM p WHERE lon <= 20 AND lon + 2 >= -10 AND lat <= 20 AND lat + 1 >= -10",
    "geo_sql": f"WITH {_P}, {_H} SELECT c_custkey, round({_M}, 1) AS meters, {_M} <= 500000 AS near FROM h WHERE lon BETWEEN 5 AND 25 AND lat BETWEEN 45 AND 60",
    "lonlat_features": f"WITH {_P} SELECT c_mktsegment AS segment, count(*) AS n, round(max(lon), 3) AS east FROM p WHERE c_custkey % 5 <> 0 GROUP BY 1",
    "geo_summary": f"""WITH {_P}, q AS (SELECT c_custkey % 3 = 0 AS multi, lon, lat FROM p) SELECT CASE WHEN multi THEN 'MultiPoint' ELSE 'Point' END AS geometry_type, count(*) AS features,
        CASE WHEN multi THEN least(0, min(lon)) ELSE min(lon) END AS min_x, CASE WHEN multi THEN least(0, min(lat)) ELSE min(lat) END AS min_y,
        CASE WHEN multi THEN greatest(0, max(lon)) ELSE max(lon) END AS max_x, CASE WHEN multi THEN greatest(0, max(lat)) ELSE max(lat) END AS max_y FROM q GROUP BY multi""",
    "quality_report": f"""WITH {_P}, v AS (SELECT *, c_custkey % 11 = 0 AS miss, c_custkey % 11 <> 0 AND c_custkey % 7 = 0 AS bad FROM p)
        SELECT count(*) AS rows, count(*) FILTER (miss) AS missing, count(*) FILTER (NOT miss AND NOT bad) AS valid, count(*) FILTER (bad) AS invalid, 'Point' AS types,
        min(lon) FILTER (NOT miss AND NOT bad) AS min_x, min(lat) FILTER (NOT miss AND NOT bad) AS min_y, max(lon) FILTER (NOT miss AND NOT bad) AS max_x,
        max(lat) FILTER (NOT miss AND NOT bad) AS max_y, 'warning' AS status FROM v""",
    "explode_multi": "SELECT 'Point' AS t, 2 * count(*) AS n, count(*) AS features FROM customer UNION ALL SELECT 'LineString', count(*), count(*) FROM customer",
    "cosine_topk": """WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, 1 - list_cosine_similarity(embedding::DOUBLE[], (SELECT v FROM q)) AS dist FROM embeddings WHERE vec_id <> 0)
        SELECT vec_id, round(dist, 6) AS distance, row_number() OVER (ORDER BY dist, vec_id) AS rank FROM s QUALIFY rank <= 20""",
    "incremental_index": """SELECT count(*) AS objects, count(*) FILTER (n_nationkey >= 20 OR n_nationkey % 2 = 1) AS fresh,
        count(*) FILTER (n_nationkey < 20 AND n_nationkey % 2 = 0) AS unchanged, count(*) FILTER (n_nationkey >= 20 OR n_nationkey % 2 = 1) AS embedded, 5 AS removed FROM nation WHERE n_nationkey >= 5""",
    "shortest_paths": f"WITH RECURSIVE {_G} SELECT CAST(id AS VARCHAR) AS id, cost FROM r",
    "reachable_features": f"WITH RECURSIVE {_G}, n AS (SELECT cost FROM r WHERE cost <= 12) SELECT 'Point' AS kind, count(*) AS n, sum(cost) AS cost FROM n UNION ALL SELECT 'Polygon', 1, NULL",
    "view_bounds": f"""WITH {_P} SELECT min(lon) AS min_x, min(lat) AS min_y, max(lon) AS max_x, max(lat) AS max_y FROM p
        UNION ALL SELECT min(lon), 6.99, max(lon), 7.01 FROM p""",
    "route_answer": f"WITH RECURSIVE {_G} SELECT cost, true AS whole, '50' AS goal, true AS line, true AS measured FROM r WHERE id = 50",
    "reachable": f"WITH RECURSIVE {_G} SELECT CAST(id AS VARCHAR) AS id, cost FROM r WHERE cost <= 12",
}
