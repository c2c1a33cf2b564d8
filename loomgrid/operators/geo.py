"""GeoJSON processing: geometries stay JSON text at rest and are taken apart by Column expressions.

Coordinates of any nesting are read as the number pairs of the text, so bounding boxes, counts and validity need no
UDF; only explosion, line simplification and hulls, which recurse, run in Arrow-batched Python.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EARTH_RADIUS_M = 6_371_008.8
TYPES = ("Point", "MultiPoint", "LineString", "MultiLineString", "Polygon", "MultiPolygon", "GeometryCollection")
LEAST_POINTS = {"Point": 1, "MultiPoint": 1, "LineString": 2, "MultiLineString": 2, "Polygon": 4, "MultiPolygon": 4}
LON_NAMES, LAT_NAMES = ("lon", "lng", "long", "longitude", "x"), ("lat", "latitude", "y")
_NUM = r"-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"
_PAIR = rf"\[\s*({_NUM})\s*,\s*({_NUM})"
_INNERMOST = r"\[[^\[\]]*\]"
_BOX = r'"bbox"\s*:\s*\[[^\[\]]*\]'


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return 2 * EARTH_RADIUS_M * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def point_json(lon: Column, lat: Column) -> Column:
    return F.to_json(F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")))


def geometry_type(g: Column) -> Column:
    t = F.get_json_object(g, "$.type")
    return F.when(t.isin(*TYPES), t)


def coordinates(g: Column) -> Column:
    """The text that holds a geometry's positions, without its bbox member; null where the text is no JSON object."""
    own = F.get_json_object(g, "$.coordinates")
    # members of a collection may nest, so its whole text is read but for the boxes in it
    members = F.when(F.get_json_object(g, "$.geometries").isNotNull(), F.regexp_replace(g, _BOX, '"bbox":null'))
    return F.coalesce(own, members)


def xs(g: Column) -> Column:
    return _numbers(coordinates(g), 1)


def ys(g: Column) -> Column:
    return _numbers(coordinates(g), 2)


def _numbers(text: Column, which: int) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(_PAIR), which), lambda v: v.cast("double"))


def bbox(g: Column) -> Column:
    """struct(min_x, min_y, max_x, max_y)"""
    return F.struct(F.array_min(xs(g)).alias("min_x"), F.array_min(ys(g)).alias("min_y"), F.array_max(xs(g)).alias("max_x"), F.array_max(ys(g)).alias("max_y"))


def view_bounds(df: DataFrame, geometry: str, pad: float = 0.01) -> DataFrame:
    """One row: the box a map opens on; an axis without extent is widened by ``pad`` on both sides."""
    b = bbox(F.col(geometry))
    out = df.agg(*[f(b[c]).alias(c) for c, f in (("min_x", F.min), ("min_y", F.min), ("max_x", F.max), ("max_y", F.max))])
    flat = lambda a: F.when(F.col(f"min_{a}") == F.col(f"max_{a}"), pad).otherwise(0.0)
    return out.select(*[(F.col(f"{end}_{a}") + sign * flat(a)).alias(f"{end}_{a}") for end, sign in (("min", -1), ("max", 1)) for a in "xy"])


def meets_bbox(g: Column, box: tuple[float, float, float, float]) -> Column:
    b = bbox(g)
    return (b.min_x <= box[2]) & (b.max_x >= box[0]) & (b.min_y <= box[3]) & (b.max_y >= box[1])


def parse_bbox(text: str) -> tuple[float, float, float, float]:
    v = tuple(float(x) for x in text.split(","))
    if len(v) != 4 or v[0] > v[2] or v[1] > v[3] or not all(map(math.isfinite, v)):
        raise ValueError(f"no bounding box: {text}")
    return v


def is_valid(g: Column) -> Column:
    """A known type, enough points of it, every position a pair of numbers within longitude and latitude limits."""
    t = geometry_type(g)
    need = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in LEAST_POINTS.items() for x in kv]), t), F.lit(1))
    ok_x = F.forall(xs(g), lambda v: (v >= -180) & (v <= 180))
    ok_y = F.forall(ys(g), lambda v: (v >= -90) & (v <= 90))
    whole = F.size(F.regexp_extract_all(coordinates(g), F.lit(_INNERMOST), 0)) == F.size(xs(g))
    return F.coalesce(t.isNotNull() & whole & (F.size(xs(g)) >= need) & ok_x & ok_y, F.lit(False))


def quality_report(df: DataFrame, geometry: str) -> DataFrame:
    """One row: rows, missing, valid, invalid, types, bounding box of valid geometries, status."""
    g = F.col(geometry)
    there = F.trim(F.coalesce(g, F.lit(""))) != ""
    good = there & is_valid(g)
    b = bbox(F.when(good, g))
    out = df.agg(
        F.count("*").alias("rows"), F.count_if(~there).alias("missing"), F.count_if(good).alias("valid"), F.count_if(there & ~is_valid(g)).alias("invalid"),
        F.array_join(F.array_sort(F.collect_set(geometry_type(g))), ",").alias("types"),
        F.min(b.min_x).alias("min_x"), F.min(b.min_y).alias("min_y"), F.max(b.max_x).alias("max_x"), F.max(b.max_y).alias("max_y"),
    )
    status = F.when(F.col("valid") + F.col("invalid") == 0, "not_spatial").when((F.col("invalid") > 0) | (F.col("missing") > 0), "warning").otherwise("ok")
    return out.withColumn("status", status)


def summary(df: DataFrame, geometry: str) -> DataFrame:
    """Features and bounding box by geometry type."""
    b = bbox(F.col(geometry))
    return df.groupBy(geometry_type(F.col(geometry)).alias("geometry_type")).agg(
        F.count("*").alias("features"), F.min(b.min_x).alias("min_x"), F.min(b.min_y).alias("min_y"), F.max(b.max_x).alias("max_x"), F.max(b.max_y).alias("max_y")
    )


def detect_geometry_column(df: DataFrame) -> str | None:
    """The column that holds GeoJSON in most rows: three points a row that parses, two for a telling name; at least three."""
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not strings:
        return None
    n = df.agg(*[F.count_if(geometry_type(F.col(c)).isNotNull()) for c in strings]).first()
    score = {c: 3 * n[i] + (2 if any(w in c.lower() for w in ("geom", "geojson", "shape")) else 0) for i, c in enumerate(strings)}
    best = max(strings, key=lambda c: score[c])
    return best if score[best] >= 3 else None


def detect_lonlat(columns: list[str]) -> tuple[str, str] | None:
    low = {c.lower(): c for c in columns}
    lon = next((low[n] for n in LON_NAMES if n in low), None)
    lat = next((low[n] for n in LAT_NAMES if n in low), None)
    return (lon, lat) if lon and lat else None


def to_features(df: DataFrame, geometry: str | None = None) -> DataFrame:
    """(geometry, properties): from a geometry column for the whole table, else from longitude and latitude in range."""
    geometry = geometry or detect_geometry_column(df)
    lonlat = None if geometry else detect_lonlat(df.columns)
    if geometry:
        props = [c for c in df.columns if c != geometry]
        g, keep = F.col(geometry), geometry_type(F.col(geometry)).isNotNull()
    elif lonlat:
        lon, lat = (F.col(c).cast("string").try_cast("double") for c in lonlat)
        props = [c for c in df.columns if c not in lonlat]
        g, keep = point_json(lon, lat), lon.between(-180, 180) & lat.between(-90, 90)
    else:
        raise ValueError("no geometry column and no longitude and latitude")
    body = F.to_json(F.struct(*[F.col(f"`{c}`") for c in props])) if props else F.lit("{}")
    return df.where(keep).select(g.alias("geometry"), body.alias("properties"))


def keep_properties(df: DataFrame, geometry: str, fields: list[str] | None = None, drop: list[str] | None = None) -> DataFrame:
    """Column choice for properties, whatever the case; dropping wins."""
    f, d = {x.lower() for x in fields or []}, {x.lower() for x in drop or []}
    return df.select(*[c for c in df.columns if c == geometry or (not f or c.lower() in f) and c.lower() not in d])


def parts(g: dict) -> list[dict]:
    """Single geometries of a geometry of any kind."""
    kind = g.get("type")
    if kind == "GeometryCollection":
        return [p for x in g.get("geometries") or [] for p in parts(x)]
    if kind in ("MultiPoint", "MultiLineString", "MultiPolygon"):
        return [{"type": kind[5:], "coordinates": c} for c in g.get("coordinates") or []]
    return [g] if kind in ("Point", "LineString", "Polygon") else []


def thin(line: list, tolerance: float, least: int) -> list:
    """Douglas-Peucker with an explicit stack; unchanged if fewer than ``least`` points would be left."""
    if tolerance <= 0 or len(line) <= least:
        return line
    keep, stack = {0, len(line) - 1}, [(0, len(line) - 1)]
    while stack:
        a, b = stack.pop()
        (x1, y1), (x2, y2) = line[a][:2], line[b][:2]
        span = math.hypot(x2 - x1, y2 - y1)
        far, at = -1.0, -1
        for i in range(a + 1, b):
            x, y = line[i][:2]
            d = math.hypot(x - x1, y - y1) if span == 0 else abs((y2 - y1) * x - (x2 - x1) * y + x2 * y1 - y2 * x1) / span
            if d > far:
                far, at = d, i
        if far > tolerance:
            keep.add(at)
            stack += [(a, at), (at, b)]
    out = [line[i] for i in sorted(keep)]
    return out if len(out) >= least else line


def thin_ring(ring: list, tolerance: float) -> list:
    """A ring thinned as the open line before its closing point and closed again; unchanged below four open points."""
    closed = len(ring) > 1 and ring[0][:2] == ring[-1][:2]
    line = ring[:-1] if closed else ring
    out = thin(line, tolerance, 4)
    return ring if len(out) == len(line) else [*out, out[0]]


def simplified(g: dict, tolerance: float) -> dict:
    c = g.get("coordinates")
    kind = g.get("type")
    if kind == "LineString":
        c = thin(c, tolerance, 2)
    elif kind == "MultiLineString":
        c = [thin(x, tolerance, 2) for x in c]
    elif kind == "Polygon":
        c = [thin_ring(x, tolerance) for x in c]
    elif kind == "MultiPolygon":
        c = [[thin_ring(x, tolerance) for x in p] for p in c]
    else:
        return g
    return {**g, "coordinates": c}


def _load(text: str | None) -> dict | None:
    try:
        g = json.loads(text) if text else None
    except ValueError:
        return None
    return g if isinstance(g, dict) and g.get("type") in TYPES else None


def simplify(g: Column, tolerance: float) -> Column:
    if tolerance < 0:
        raise ValueError("the tolerance must not be negative")

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: t if (x := _load(t)) is None else json.dumps(simplified(x, tolerance), separators=(",", ":")))

    return run(g)


def explode_parts(df: DataFrame, geometry: str) -> DataFrame:
    """One row for each single geometry; rows of unknown geometry go."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [] if (x := _load(t)) is None else [json.dumps(p, separators=(",", ":")) for p in parts(x)])

    return df.withColumn(geometry, F.explode(run(F.col(geometry))))


def process(df: DataFrame, geometry: str, explode: bool = False, tolerance: float = 0.0, box: tuple | None = None, fields: list[str] | None = None, drop: list[str] | None = None) -> DataFrame:
    """Explode, simplify, filter by bounding box, choose properties: in this order."""
    if explode:
        df = explode_parts(df, geometry)
    if tolerance:
        df = df.withColumn(geometry, simplify(F.col(geometry), tolerance))
    if box:
        df = df.where(meets_bbox(F.col(geometry), box))
    return keep_properties(df, geometry, fields, drop)


def hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Convex hull, counter-clockwise, without collinear points; fewer than three points make none."""
    p = sorted(set(points))
    if len(p) < 3:
        return []

    def half(seq: list) -> list:
        out: list = []
        for q in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return half(p) + half(p[::-1])


def convex_hulls(df: DataFrame, key: str, lon: str, lat: str) -> DataFrame:
    """key, hull (a closed Polygon as JSON). Hulls of each batch come first, so a group meets only as hull points."""
    kind = df.schema[key].dataType.simpleString()

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pdf = b.to_pandas()
            points = {k: list(zip(g[lon], g[lat])) for k, g in pdf.groupby(key, dropna=False)}
            rows = [(k, *p) for k, pts in points.items() for p in hull(pts) or sorted(set(pts))]
            yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=[key, lon, lat]), schema=b.schema, preserve_index=False)

    def final(pdf: pd.DataFrame) -> pd.DataFrame:
        h = hull(list(zip(pdf[lon], pdf[lat])))
        return pd.DataFrame({key: [pdf[key].iloc[0]], "hull": [json.dumps({"type": "Polygon", "coordinates": [[list(x) for x in h + h[:1]]]}) if h else None]})

    rows = df.select(key, F.col(lon).cast("double").alias(lon), F.col(lat).cast("double").alias(lat)).dropna(subset=[lon, lat])
    few = rows.mapInArrow(local, f"{key} {kind}, {lon} double, {lat} double")
    return few.groupBy(key).applyInPandas(final, f"{key} {kind}, hull string")


def register_functions(spark: SparkSession) -> None:
    """Geo functions for SQL text, defined in SQL so that Catalyst sees through them."""
    x, y = "CAST(get_json_object({0}, '$.coordinates[0]') AS DOUBLE)", "CAST(get_json_object({0}, '$.coordinates[1]') AS DOUBLE)"
    dist = (
        f"2 * {EARTH_RADIUS_M} * asin(sqrt(pow(sin(radians({y.format('b')} - {y.format('a')}) / 2), 2) + cos(radians({y.format('a')})) * cos(radians({y.format('b')}))"
        f" * pow(sin(radians({x.format('b')} - {x.format('a')}) / 2), 2)))"
    )
    point = "to_json(struct('Point' AS type, array(x, y) AS coordinates))"
    for name, args, kind, body in (
        ("geo_point", "x DOUBLE, y DOUBLE", "STRING", point), ("st_makepoint", "x DOUBLE, y DOUBLE", "STRING", point),
        ("geo_x", "a STRING", "DOUBLE", x.format("a")), ("geo_y", "a STRING", "DOUBLE", y.format("a")),
        ("geo_distance", "a STRING, b STRING", "DOUBLE", dist), ("geo_dwithin", "a STRING, b STRING, m DOUBLE", "BOOLEAN", f"{dist} <= m"),
        ("geo_within_bbox", "a STRING, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE", "BOOLEAN", f"{x.format('a')} BETWEEN x1 AND x2 AND {y.format('a')} BETWEEN y1 AND y2"),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
