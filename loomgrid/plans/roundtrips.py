"""Whole tables written in a format and read back by its reader, with the tables themselves as SQL twins.

Formats without a sink here are laid out as text by Columns, or as bytes by small writers of this module.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.operators import geo
from loomgrid.session import shared_dir, table
from loomgrid.sinks import writers as W
from loomgrid.sources import readers as R


def _room(spark: SparkSession, ending: str) -> str:
    """A new path in the shared folder that is deleted when the application ends."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/roundtrip-{uuid.uuid4().hex}.{ending}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path.getParent())
    fs.deleteOnExit(path)
    return path.toString().removeprefix("file:")


def _suppliers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")


def _noted(spark: SparkSession, d: str) -> DataFrame:
    """Customers with a note that holds separators, quotes, line breaks, markup and blanks."""
    note = F.concat(F.col("c_mktsegment"), F.lit(', "x" & <y>\nline two\tend;'))
    return table(spark, d, "customer").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 3 == 0, note).when(F.col("c_custkey") % 3 == 1, F.col("c_mktsegment")).alias("note"), "c_acctbal")


def _back(fmt: str, rows: Callable, write: Callable) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, d: str) -> DataFrame:
        path = _room(spark, fmt)
        write(rows(spark, d), path)
        return R.read(spark, path, fmt)

    return query


def excel_csv_back(spark: SparkSession, d: str) -> DataFrame:
    path = _room(spark, "csv")
    W.write_excel_csv(_suppliers(spark, d), path)
    lines = spark.read.text(path).select(F.regexp_replace("value", "^﻿", "").alias("line"))
    return lines.where(~F.col("line").startswith("sep=") & (F.col("line") != "s_suppkey,s_name,s_nationkey,s_acctbal"))


def sqlite_back(spark: SparkSession, d: str) -> DataFrame:
    path = _room(spark, "sqlite")
    W.write_sqlite(_noted(spark, d), path, "customer")
    return R.read(spark, path).where("source_table = 'customer'").drop("source_table")


def html_back(spark: SparkSession, d: str) -> DataFrame:
    path = _room(spark, "html")
    W.write_html(_suppliers(spark, d), path)
    return R.read_text(spark, path).where("row_index <> '1'").select("table_index", "col_1", "col_2", "col_3", F.col("col_4").cast("double").alias("col_4"))


def _text(df: DataFrame, path: str, *parts: str | object) -> None:
    df.select(F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]).alias("value")).write.text(path)


def ics_back(spark: SparkSession, d: str) -> DataFrame:
    path, o = _room(spark, "ics"), table(spark, d, "orders")
    day = F.date_format("o_orderdate", "yyyyMMdd")
    _text(o, path, "BEGIN:VCALENDAR\nBEGIN:VEVENT\nUID:", o.o_orderkey, "\nSUMMARY:", o.o_orderpriority, "\\, of\n  ", o.o_custkey, "\nDTSTART;VALUE=DATE:", day, "\nEND:VEVENT\nEND:VCALENDAR")
    return R.read_text(spark, path).select("component", F.col("uid").cast("long").alias("uid"), "summary", "start")


def vcf_back(spark: SparkSession, d: str) -> DataFrame:
    path, c = _room(spark, "vcf"), table(spark, d, "customer")
    _text(c, path, "BEGIN:VCARD\nVERSION:3.0\nFN:", c.c_name, "\nORG:", c.c_mktsegment, "\nEMAIL;TYPE=work:c", c.c_custkey, "@a.example\nEMAIL:d", c.c_custkey, "@b.example\nEND:VCARD")
    return R.read_text(spark, path).select("full_name", "organization", "email")


def ini_back(spark: SparkSession, d: str) -> DataFrame:
    path, s = _room(spark, "ini"), _suppliers(spark, d)
    _text(s, path, "; a supplier\n[s", s.s_suppkey, "]\nname = \"", s.s_name, "\"\nnation: ", s.s_nationkey)
    return R.read(spark, path)


def toml_back(spark: SparkSession, d: str) -> DataFrame:
    path, s = _room(spark, "toml"), _suppliers(spark, d)
    _text(s, path, "[[supplier]]\nid = ", s.s_suppkey, "\nname = '", s.s_name, "'\nbalance = ", F.format_string("%.2f", "s_acctbal"), "\n")
    return R.read(spark, path)


def yaml_back(spark: SparkSession, d: str) -> DataFrame:
    path, s = _room(spark, "yaml"), _suppliers(spark, d)
    _text(s, path, "- id: ", s.s_suppkey, "\n  name: '", s.s_name, "'\n  nation: {key: ", s.s_nationkey, "}")
    return R.read(spark, path).select("id", "name", F.get_json_object("nation", "$.key").cast("int").alias("nation"))


def fwf_back(spark: SparkSession, d: str) -> DataFrame:
    path, s = _room(spark, "fwf"), _suppliers(spark, d)

    def lines() -> Iterator[str]:
        yield f"{'id':<12} {'name':<24} {'balance':>14}"
        for r in s.toLocalIterator():
            yield f"{r.s_suppkey:<12} {r.s_name:<24} {r.s_acctbal:>14.2f}"

    W.write_lines(path, lines())
    return R.read(spark, path)


def _bytes(df: DataFrame, path: str, head: Callable[[int], bytes], one: Callable) -> None:
    with open(path, "wb") as f:
        f.write(head(df.count()))
        f.writelines(one(r.s_suppkey, r.s_name, r.s_acctbal) for r in df.toLocalIterator())


def msgpack_back(spark: SparkSession, d: str) -> DataFrame:
    path = _room(spark, "msgpack")
    text = lambda s: b"\xd9" + bytes([len(s.encode())]) + s.encode()
    _bytes(_suppliers(spark, d), path, lambda n: b"\xdd" + struct.pack(">I", n), lambda k, n, b: b"\x83\xa2id\xd3" + struct.pack(">q", k) + b"\xa4name" + text(n) + b"\xa3bal\xcb" + struct.pack(">d", b))
    return R.read(spark, path)


def cbor_back(spark: SparkSession, d: str) -> DataFrame:
    path = _room(spark, "cbor")
    text = lambda s: b"\x78" + bytes([len(s.encode())]) + s.encode()
    _bytes(_suppliers(spark, d), path, lambda n: b"\x9a" + struct.pack(">I", n), lambda k, n, b: b"\xa3\x62id\x1b" + struct.pack(">Q", k) + b"\x64name" + text(n) + b"\x63bal\xfb" + struct.pack(">d", b))
    return R.read(spark, path)


def bson_back(spark: SparkSession, d: str) -> DataFrame:
    path = _room(spark, "bson")

    def one(k: int, n: str, b: float) -> bytes:
        body = b"\x12id\0" + struct.pack("<q", k) + b"\x02name\0" + struct.pack("<i", len(n.encode()) + 1) + n.encode() + b"\0\x01bal\0" + struct.pack("<d", b) + b"\0"
        return struct.pack("<i", len(body) + 4) + body

    _bytes(_suppliers(spark, d), path, lambda n: b"", one)
    return R.read(spark, path)


def osm_back(spark: SparkSession, d: str) -> DataFrame:
    """A node for each customer and a way over every two of a row; ways find their nodes by a join."""
    path, c = _room(spark, "osm"), table(spark, d, "customer")

    def lines() -> Iterator[str]:
        yield "<osm version='0.6'>"
        for r in c.select("c_custkey", "c_mktsegment").toLocalIterator():
            k = r.c_custkey
            yield f"<node id='{k}' lon='{k * 37 % 360 - 180}' lat='{k * 17 % 180 - 90}'><tag k='name' v='{r.c_mktsegment}'/></node>"
            if k:
                yield f"<way id='{k}'><nd ref='{k - 1}'/><nd ref='{k}'/><tag k='highway' v='path'/></way>"
        yield "</osm>"

    W.write_lines(path, lines())
    numbers = F.from_json(F.get_json_object("geometry", "$.coordinates"), "array<double>")
    ends = F.from_json(F.get_json_object("geometry", "$.coordinates"), "array<array<double>>")
    lon = F.when(F.col("record_type") == "node", numbers[0]).otherwise(ends[1][0])
    return R.read_text(spark, path, "osm").select("record_type", F.col("osm_id").cast("long").alias("osm_id"), "geometry_type", "name", "highway", lon.alias("lon"))


def _features(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    place = geo.point_json((k * 37 % 3600 / 10 - 180), (k * 17 % 1800 / 10 - 90))
    return table(spark, d, "customer").select(place.alias("geometry"), F.to_json(F.struct(k.cast("string").alias("id"), F.col("c_mktsegment").alias("name"))).alias("properties"))


def _places_back(fmt: str, write: Callable, read: Callable) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, d: str) -> DataFrame:
        path = _room(spark, fmt)
        write(_features(spark, d), path)
        at = F.from_json(F.get_json_object("geometry", "$.coordinates"), "array<double>")
        return read(R.read_text(spark, path, {"zip": "shapefile"}.get(fmt, fmt))).select("*", at[0].alias("lon"), at[1].alias("lat")).drop("geometry")

    return query


def _attributes(df: DataFrame) -> DataFrame:
    pick = lambda k: F.trim(F.get_json_object("attributes", f"$.{k}"))
    return df.select("geometry", "geometry_type", pick("ID").cast("long").alias("id"), pick("NAME").alias("name"))


def mbtiles_back(spark: SparkSession, d: str) -> DataFrame:
    """A tile for each supplier, read back with the hash of its bytes."""
    import sqlite3

    path, s = _room(spark, "mbtiles"), _suppliers(spark, d)
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE metadata (name TEXT, value TEXT)")
        db.execute("INSERT INTO metadata VALUES ('name', 'suppliers')")
        db.execute("CREATE TABLE tiles (zoom_level INTEGER, tile_column INTEGER, tile_row INTEGER, tile_data BLOB)")
        db.executemany("INSERT INTO tiles VALUES (20, ?, 1, ?)", ((r.s_suppkey, r.s_name.encode()) for r in s.toLocalIterator()))
    db.close()
    tiles = R.read_text(spark, path, "mbtiles").where("record_type = 'tile'")
    return tiles.select(F.col("tile_column").cast("long").alias("tile_column"), F.col("tile_row").cast("long").alias("tile_row"), "tile_sha256")


def provenance_back(spark: SparkSession, d: str) -> DataFrame:
    """How many files a load of one written table reads, and whether each has its hash, size and time."""
    path = _room(spark, "ndjson")
    W.write_ndjson(_suppliers(spark, d).coalesce(1), path)
    p = R.provenance(spark, path)
    return p.agg(F.count("*").alias("files"), F.bool_and((F.length("sha256") == 64) & (F.col("size_bytes") > 0) & F.col("modified").isNotNull()).alias("complete"))


QUERIES = {
    "csv_back": _back("csv", _noted, W.write_csv),
    "tsv_back": _back("tsv", _suppliers, lambda df, path: W.write_csv(df, path, "\t")),
    "ndjson_back": _back("ndjson", _noted, W.write_ndjson),
    "json_back": _back("json", _noted, W.write_json),
    "xml_back": _back("xml", _noted, W.write_xml),
    "xlsx_back": _back("xlsx", _noted, W.write_xlsx),
    "geojson_back": _places_back("geojson", W.write_geojson, lambda df: df.select("geometry", "geometry_type", F.col("id").cast("long").alias("id"), "name")),
    "kml_back": _places_back("kml", W.write_kml, lambda df: df.select("geometry", "geometry_type", F.col("id").cast("long").alias("id"), "name")),
    "gpx_back": _places_back("gpx", W.write_gpx, lambda df: df.select("geometry", "geometry_type", "record_type", "name")),
    "shapefile_back": _places_back("zip", W.write_shapefile, _attributes),
} | {f.__name__: f for f in (excel_csv_back, sqlite_back, html_back, ics_back, vcf_back, ini_back, toml_back, yaml_back, fwf_back, msgpack_back, cbor_back, bson_back, osm_back, mbtiles_back, provenance_back)}

_NOTED = """SELECT c_custkey, c_name, CASE c_custkey % 3 WHEN 0 THEN c_mktsegment || ', "x" & <y>' || chr(10) || 'line two' || chr(9) || 'end;' WHEN 1 THEN c_mktsegment END AS note, c_acctbal FROM customer"""
_PLACE = "'Point' AS geometry_type, CAST(c_custkey * 37 % 3600 / 10 - 180 AS DOUBLE) AS lon, CAST(c_custkey * 17 % 1800 / 10 - 90 AS DOUBLE) AS lat, c_mktsegment AS name"
_PLACED = f"SELECT c_custkey AS id, {_PLACE} FROM customer"
_BINARY = "SELECT s_suppkey AS id, s_name AS name, s_acctbal AS bal FROM supplier"

ORACLES = {name: _NOTED for name in ("csv_back", "ndjson_back", "json_back", "xml_back", "sqlite_back", "xlsx_back")} | {
    "tsv_back": "SELECT s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, s_acctbal FROM supplier",
    "excel_csv_back": "SELECT s_suppkey || ',' || s_name || ',' || s_nationkey || ',' || s_acctbal AS line FROM supplier",
    "html_back": "SELECT '1' AS table_index, CAST(s_suppkey AS VARCHAR) AS col_1, s_name AS col_2, CAST(s_nationkey AS VARCHAR) AS col_3, s_acctbal AS col_4 FROM supplier",
    "ics_back": "SELECT 'VEVENT' AS component, o_orderkey AS uid, o_orderpriority || ', of ' || o_custkey AS summary, strftime(o_orderdate, '%Y%m%d') AS start FROM orders",
    "vcf_back": "SELECT c_name AS full_name, c_mktsegment AS organization, 'c' || c_custkey || '@a.example; d' || c_custkey || '@b.example' AS email FROM customer",
    "ini_back": "SELECT 's' || s_suppkey AS section, s_name AS name, CAST(s_nationkey AS BIGINT) AS nation FROM supplier",
    "toml_back": "SELECT s_suppkey AS id, s_name AS name, s_acctbal AS balance FROM supplier",
    "yaml_back": "SELECT s_suppkey AS id, s_name AS name, s_nationkey AS nation FROM supplier",
    "fwf_back": "SELECT s_suppkey AS id, s_name AS name, s_acctbal AS balance FROM supplier",
    "msgpack_back": _BINARY,
    "cbor_back": _BINARY,
    "bson_back": _BINARY,
    "osm_back": """SELECT 'node' AS record_type, c_custkey AS osm_id, 'Point' AS geometry_type, c_mktsegment AS name, NULL AS highway, CAST(c_custkey * 37 % 360 - 180 AS DOUBLE) AS lon FROM customer
        UNION ALL SELECT 'way', c_custkey, 'LineString', NULL, 'path', CAST(c_custkey * 37 % 360 - 180 AS DOUBLE) FROM customer WHERE c_custkey > 0""",
    "geojson_back": _PLACED,
    "kml_back": _PLACED,
    "gpx_back": f"SELECT 'waypoint' AS record_type, {_PLACE} FROM customer",
    "shapefile_back": _PLACED,
    "mbtiles_back": "SELECT s_suppkey AS tile_column, CAST(1 AS BIGINT) AS tile_row, sha256(s_name) AS tile_sha256 FROM supplier",
    "provenance_back": "SELECT CAST(1 AS BIGINT) AS files, true AS complete",
}
