"""Shortest paths and reachability on routing graphs by rounds of relaxation over DataFrames.

Only the nodes whose cost fell in the last round are extended in the next, so a round costs what its frontier touches.
Each round's state is written with checkpoint() (into the shared folder), which cuts the lineage and
survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.operators.geo import EARTH_RADIUS_M, convex_hulls, haversine_m, hull, point_json
from loomgrid.session import shared_dir

__all__ = ["EARTH_RADIUS_M", "edges_of", "hull", "nearest_node", "nodes_of", "path", "reachable", "reachable_features", "route", "shortest"]

FROM, TO = ("from_id", "from", "source", "u"), ("to_id", "to", "target", "v")
COST, DISTANCE = ("cost", "weight", "duration"), ("distance", "length", "meters")


def first_of(df: DataFrame, names: tuple[str, ...], kind: str):
    have = {c.lower(): c for c in df.columns}
    cols = [F.col(have[n]).cast("string").try_cast(kind) if kind != "string" else F.col(have[n]).cast("string") for n in names if n in have]
    return F.coalesce(*cols) if cols else F.lit(None).cast(kind)


def nodes_of(df: DataFrame) -> DataFrame:
    """id, lon, lat; coordinates out of range are null, rows without an id go."""
    lon, lat = first_of(df, ("lon", "lng", "longitude", "x"), "double"), first_of(df, ("lat", "latitude", "y"), "double")
    ok = lon.between(-180, 180) & lat.between(-90, 90)
    return df.select(F.col("id").cast("string").alias("id"), F.when(ok, lon).alias("lon"), F.when(ok, lat).alias("lat")).where("id IS NOT NULL AND id <> ''")


def edges_of(df: DataFrame, nodes: DataFrame, cost_field: str = "cost", undirected: bool = False) -> DataFrame:
    """src, dst, cost, meters: edges between known nodes. Cost and distance fall back to the great-circle distance, other fields must be there.

    Of edges between the same two nodes the cheapest stays, then the shortest.
    """
    named = {"cost": COST, "distance": DISTANCE}.get(cost_field)
    cost = first_of(df, named, "double") if named else F.get_json_object("properties", f"$.{cost_field}").try_cast("double")
    e = df.select(first_of(df, FROM, "string").alias("src"), first_of(df, TO, "string").alias("dst"), cost.alias("own"), first_of(df, DISTANCE, "double").alias("long"))
    e = e.join(nodes.select(F.col("id").alias("src"), F.col("lon").alias("x1"), F.col("lat").alias("y1")), "src").join(nodes.select(F.col("id").alias("dst"), F.col("lon").alias("x2"), F.col("lat").alias("y2")), "dst")
    away = haversine_m(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    e = e.select("src", "dst", (F.coalesce("own", away) if named else F.col("own")).alias("cost"), F.coalesce("long", away).alias("meters"))
    e = e.withColumn("cost", F.when(F.col("cost") >= 0, F.col("cost")).otherwise(F.raise_error(F.concat(F.lit("no cost, or a negative one, on edge "), "src", F.lit(" - "), "dst"))))
    if undirected:
        e = e.unionAll(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "cost", "meters"))
    return e.groupBy("src", "dst").agg(F.min(F.struct("cost", "meters")).alias("m")).select("src", "dst", "m.cost", "m.meters")


def _cut(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def shortest(edges: DataFrame, start: str, max_cost: float | None = None) -> DataFrame:
    """id, cost, pred, hops: the cheapest way from ``start`` to every node within ``max_cost``; ties by the lesser predecessor."""
    spark = edges.sparkSession
    best = _cut(spark.createDataFrame([(start, 0.0, None, 0, True)], "id string, cost double, pred string, hops int, new boolean"))
    while True:
        ahead = best.where("new").join(edges, best.id == edges.src).select(F.col("dst").alias("id"), (best.cost + edges.cost).alias("cost"), F.col("src").alias("pred"), (F.col("hops") + 1).alias("hops"), F.lit(True).alias("new"))
        if max_cost is not None:
            ahead = ahead.where(F.col("cost") <= max_cost)
        old = best.withColumn("new", F.lit(False))
        pick = F.min(F.struct("cost", F.col("new").cast("int").alias("n"), "pred", "hops", "new"))  # an equal cost keeps the old entry
        best = _cut(old.unionByName(ahead).groupBy("id").agg(pick.alias("m")).select("id", "m.cost", "m.pred", "m.hops", "m.new"))
        if not best.where("new").limit(1).count():
            return best.select("id", "cost", "pred", "hops")


def path(costs: DataFrame, goal: str) -> list[tuple[str, float]]:
    """Nodes and costs from the start to ``goal``; empty if it was not reached. The walk reads one row a step."""
    out, at = [], goal
    while at is not None:
        row = costs.where(F.col("id") == at).first()
        if row is None:
            return []
        out.append((row["id"], row["cost"]))
        at = row["pred"]
    return out[::-1]


def route(nodes: DataFrame, edges: DataFrame, start: str, goal: str) -> DataFrame:
    """One row: node_ids, edge_count, cost, distance_meters and the LineString of the cheapest way; no row if there is none.

    The distance is null if an edge has neither a distance nor the coordinates for one; nodes without coordinates and
    repeated positions are left out of the line, which is null below two positions.
    """
    spark = edges.sparkSession
    way = path(shortest(edges, start), goal)
    steps = spark.createDataFrame([(i, k, c, way[i - 1][0] if i else None) for i, (k, c) in enumerate(way)], "i int, id string, cost double, src string")
    # a way is short beside the graph, but its length is not bounded: no hint, so that sizes decide
    at = steps.join(nodes.select("id", "lon", "lat").dropDuplicates(["id"]), "id", "left")
    at = at.join(edges.select("src", F.col("dst").alias("id"), "meters"), ["src", "id"], "left")
    rows = F.array_sort(F.collect_list(F.struct("i", "id", "cost", "meters", "lon", "lat")))
    out = at.agg(rows.alias("p")).where(F.size("p") > 0)
    points = F.transform(F.filter("p", lambda x: x["lon"].isNotNull() & x["lat"].isNotNull()), lambda x: F.array(x["lon"], x["lat"]))
    out = out.withColumn("q", points).withColumn("q", F.filter("q", lambda x, i: (i == 0) | (x != F.try_element_at("q", F.greatest(i, F.lit(1))))))
    line = F.to_json(F.struct(F.lit("LineString").alias("type"), F.col("q").alias("coordinates")))
    return out.select(
        F.transform("p", lambda x: x["id"]).alias("node_ids"), (F.size("p") - 1).alias("edge_count"), F.element_at("p", -1)["cost"].alias("cost"),
        F.aggregate(F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0))), F.lit(0.0), lambda a, x: a + x["meters"]).alias("distance_meters"),
        F.when(F.size("q") > 1, line).alias("geometry"),
    )


def reachable_features(nodes: DataFrame, costs: DataFrame, max_cost: float) -> DataFrame:
    """(geometry, properties): the hull of the reached nodes as a Polygon, if they have one, and a Point for each."""
    at = costs.join(nodes.where("lon IS NOT NULL AND lat IS NOT NULL").select("id", "lon", "lat"), "id")
    props = F.to_json(F.struct(F.col("id").alias("node_id"), "cost", F.lit(True).alias("reachable")))
    area = convex_hulls(at.select(F.lit(0).alias("all"), "lon", "lat"), "all", "lon", "lat").where("hull IS NOT NULL")
    about = F.to_json(F.struct(F.lit(float(max_cost)).alias("max_cost"), F.lit("convex_hull").alias("method")))
    return area.select(F.col("hull").alias("geometry"), about.alias("properties")).unionAll(at.select(point_json(F.col("lon"), F.col("lat")), props))


def reachable(edges: DataFrame, start: str, max_cost: float) -> DataFrame:
    if max_cost <= 0:
        raise ValueError("max_cost must be positive")
    return shortest(edges, start, max_cost).select("id", "cost").orderBy("id")


def nearest_node(nodes: DataFrame, lon: float, lat: float) -> DataFrame:
    """id, meters of the node closest to a point; ties by id."""
    d = haversine_m(F.lit(float(lon)), F.lit(float(lat)), F.col("lon"), F.col("lat"))
    return nodes.where("lon IS NOT NULL AND lat IS NOT NULL").select("id", d.alias("meters")).orderBy("meters", "id").limit(1)
