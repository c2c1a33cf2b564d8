"""Readers: every format as a DataFrame, typed in one pass.

CSV, TSV, NDJSON, Parquet, ORC and JDBC go through Spark's own splittable readers. The other formats are one value a file:
files are dealt out as binaryFile rows and decoded in Arrow batches, so parallelism is over files.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.functions.cells import column_name, looks_like_header, typed, unique_names
from loomgrid.sources import decoders as D
from loomgrid.sources import geodecoders as G

DECODERS: dict[str, Callable[[bytes], Iterator[D.Record]]] = {
    "json": D.json_array, "multiline_ndjson": D.ndjson, "yaml": D.yaml_list, "toml": D.toml, "ini": D.ini, "xml": D.result_xml, "fwf": D.fixed_width,
    "html": D.html_tables, "ics": D.icalendar, "vcf": D.vcard, "msgpack": D.msgpack, "cbor": D.cbor, "bson": D.bson, "sqlite": D.sqlite_tables, "xlsx": D.xlsx,
    "geojson": G.geojson, "kml": G.kml, "gpx": G.gpx, "shapefile": G.shapefile_zip, "mbtiles": G.mbtiles, "pmtiles": G.pmtiles, "gpkg": G.geopackage,
    "routing": G.routing_graph,
}
EXTENSIONS = {
    "csv": "csv", "tsv": "tsv", "tab": "tsv", "json": "json", "ndjson": "ndjson", "jsonl": "ndjson", "yaml": "yaml", "yml": "yaml", "toml": "toml", "ini": "ini", "cfg": "ini",
    "xml": "xml", "fwf": "fwf", "txt": "fwf", "html": "html", "htm": "html", "ics": "ics", "vcf": "vcf", "msgpack": "msgpack", "cbor": "cbor", "bson": "bson", "db": "sqlite",
    "sqlite": "sqlite", "sqlite3": "sqlite", "xlsx": "xlsx", "geojson": "geojson", "kml": "kml", "gpx": "gpx", "osm": "osm", "pbf": "pbf", "zip": "shapefile", "mbtiles": "mbtiles",
    "pmtiles": "pmtiles", "gpkg": "gpkg", "parquet": "parquet", "orc": "orc", "arrow": "arrow", "feather": "feather", "duckdb": "duckdb",
}


def format_of(path: str) -> str:
    name = path.rstrip("/").rpartition("/")[2].lower()
    found = EXTENSIONS.get(name.rpartition(".")[2])
    if found is None:
        raise ValueError(f"no format is known for {name}")
    return found


def table_name_of(path: str) -> str:
    return column_name(path.rstrip("/").rpartition("/")[2].rsplit(".", 1)[0].lower(), 1)


def files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def records(spark: SparkSession, path: str, decode: Callable[[bytes], Iterator[D.Record]]) -> DataFrame:
    """(file, seq, keys array<string>, cells array<string>): one row per record of each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                name, seq, keys, values = b.column(0)[i].as_py(), [], [], []
                for n, r in enumerate(decode(b.column(1)[i].as_py())):
                    seq.append(n)
                    keys.append(list(r))
                    values.append(list(r.values()))
                    if len(seq) == 5_000:
                        yield _batch(name, seq, keys, values)
                        seq, keys, values = [], [], []
                if seq:
                    yield _batch(name, seq, keys, values)

    return files(spark, path).mapInArrow(run, "file string, seq long, keys array<string>, cells array<string>")


def _batch(name: str, seq: list, keys: list, values: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([name] * len(seq)), pa.array(seq, pa.int64()), pa.array(keys, pa.list_(pa.string())), pa.array(values, pa.list_(pa.string()))], ["file", "seq", "keys", "cells"])


def flatten(recs: DataFrame) -> DataFrame:
    """The union of all keys as text columns, in order of first appearance; names become unique identifiers."""
    first = F.min(F.struct("file", "seq", "pos"))
    order = [r["key"] for r in recs.select("file", "seq", F.posexplode("keys").alias("pos", "key")).groupBy("key").agg(first.alias("f")).orderBy("f").collect()]
    cell = lambda k: F.get("cells", F.array_position("keys", k).cast("int") - 1)
    return recs.select(*[F.when(F.array_contains("keys", k), cell(k)).alias(n) for k, n in zip(order, unique_names(order))])


def read_delimited(spark: SparkSession, path: str, sep: str | None = None, header: str = "auto", encoding: str = "auto") -> DataFrame:
    """CSV or TSV as text columns; separator and header are found in the first file unless given.

    The encoding and whether a quoted cell holds a line break are found over all lines, split by split. Only files with such
    cells, and those in UTF-16, are read whole by one task each; all others stay splittable.
    """
    raw = spark.read.text(path)
    quotes = F.octet_length("value") - F.octet_length(F.replace("value", F.lit('"'), F.lit("")))
    first = raw.select(F.substring(F.col("value").cast("binary"), 1, 2)).first()
    wide = first is not None and bytes(first[0]) in (b"\xff\xfe", b"\xfe\xff") or encoding.upper().startswith("UTF-16")
    found = raw.agg(F.bool_and(F.is_valid_utf8("value")).alias("utf8"), F.bool_or(quotes % 2 == 1).alias("broken")).first()
    if encoding == "auto":
        encoding = "UTF-16" if wide else "UTF-8" if found["utf8"] is not False else "ISO-8859-1"
    lines = [r[0] for r in spark.read.option("encoding", encoding).csv(path, sep="\u0001", encoding=encoding, quote="").limit(2).collect()]
    top = (lines[0] if lines else "") or ""
    sep = sep or ("\t" if top.count("\t") > top.count(",") else ",")
    head = [c.strip().strip('"').lstrip("﻿") for c in top.split(sep)]
    named = header == "present" or header == "auto" and looks_like_header([head, lines[1].split(sep) if len(lines) > 1 and lines[1] else []][: len(lines)])
    df = spark.read.csv(path, sep=sep, encoding=encoding, header=named, inferSchema=False, quote='"', escape='"', multiLine=wide or bool(found["broken"]), mode="PERMISSIVE", enforceSchema=True)
    names = unique_names([c.lstrip("﻿") for c in df.columns]) if named else [f"col_{i}" for i in range(1, len(df.columns) + 1)]
    return df.toDF(*names)


def read_osm(spark: SparkSession, path: str, pbf: bool = False) -> DataFrame:
    """Tagged nodes, ways resolved against their nodes by a join, and relations without geometry."""
    decode = G.osm_pbf_objects if pbf else G.osm_objects

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                rows = list(decode(b.column(1)[i].as_py()))
                cols = list(zip(*rows)) if rows else [()] * 6
                kinds = [pa.string(), pa.string(), pa.float64(), pa.float64(), pa.list_(pa.string()), pa.map_(pa.string(), pa.string())]
                cols[5] = [list(x.items()) for x in cols[5]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["kind", "id", "lon", "lat", "refs", "tags"])

    o = files(spark, path).mapInArrow(run, "kind string, id string, lon double, lat double, refs array<string>, tags map<string,string>")
    nodes = o.where("kind = 'node' AND lon IS NOT NULL AND lat IS NOT NULL")
    ways = o.where("kind = 'way'")
    ref = ways.select(F.col("id").alias("way"), F.posexplode("refs").alias("pos", "ref"))
    line = ref.join(nodes.select(F.col("id").alias("ref"), F.array("lon", "lat").alias("p")), "ref").groupBy("way").agg(F.sort_array(F.collect_list(F.struct("pos", "ref", "p"))).alias("x"))
    closed = (F.size("x") >= 4) & (F.element_at("x", 1)["ref"] == F.element_at("x", -1)["ref"])
    c = F.col("x.p")
    shape = F.when(closed, F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(c).alias("coordinates")))).when(F.size("x") >= 2, F.to_json(F.struct(F.lit("LineString").alias("type"), c.alias("coordinates"))))
    point = F.to_json(F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")))
    tagged = nodes.where(F.size(F.map_keys("tags")) > 0).select("kind", "id", point.alias("geometry"), "tags")
    whole = ways.join(line, ways.id == line.way, "left").select("kind", "id", shape.alias("geometry"), "tags")
    rel = o.where("kind = 'relation'").select("kind", "id", F.lit(None).cast("string").alias("geometry"), "tags")
    tag = lambda k: F.try_element_at("tags", F.lit(k)).alias(k)
    return tagged.unionByName(whole).unionByName(rel).select(
        F.col("kind").alias("record_type"), F.col("id").alias("osm_id"), "geometry", F.get_json_object("geometry", "$.type").alias("geometry_type"),
        *[tag(k) for k in ("name", "highway", "amenity", "natural", "building")], F.to_json("tags").alias("tags"),
    )


def read_manifest(spark: SparkSession, path: str, kind: str) -> DataFrame:
    f = spark.read.format("binaryFile").load(path)
    return f.select(F.lit(kind).alias("file_format"), F.col("length").alias("size_bytes"), F.lower(F.hex(F.substring("content", 1, 16))).alias("magic"), F.lit("read the rows with the columnar reader").alias("note"))


def read_text(spark: SparkSession, path: str, fmt: str | None = None, **options: str) -> DataFrame:
    """Any format as text columns (columnar formats keep their types)."""
    fmt = fmt or format_of(path)
    if fmt in ("csv", "tsv"):
        return read_delimited(spark, path, sep="\t" if fmt == "tsv" else options.pop("sep", None), **options)
    if fmt == "ndjson":
        df = spark.read.option("primitivesAsString", True).json(path)
        return df.select(*[(F.to_json(F.col(f"`{f.name}`")) if f.dataType.typeName() in ("struct", "array", "map") else F.col(f"`{f.name}`")).alias(f.name) for f in df.schema.fields])
    if fmt in ("parquet", "orc"):
        return spark.read.format(fmt).load(path)
    if fmt in ("arrow", "feather", "duckdb"):
        return read_manifest(spark, path, fmt)
    if fmt in ("osm", "pbf"):
        return read_osm(spark, path, fmt == "pbf")
    return flatten(records(spark, path, DECODERS[fmt]))


def read(spark: SparkSession, path: str, fmt: str | None = None, **options: str) -> DataFrame:
    """Any format with inferred column types."""
    df = read_text(spark, path, fmt, **options)
    return df if (fmt or format_of(path)) in ("parquet", "orc") else typed(df)


def provenance(spark: SparkSession, path: str) -> DataFrame:
    """File name, SHA-256, size and time of what a load reads."""
    f = spark.read.format("binaryFile").load(path)
    return f.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"))


def jdbc_options(dsn: str) -> dict[str, str]:
    """Reader options from a connection string: URL, host=... pairs or a file path."""
    import re

    low = dsn.lower()
    for prefix, kind in (("postgres", "postgresql"), ("mysql", "mysql"), ("mariadb", "mysql"), ("sqlserver", "sqlserver"), ("mssql", "sqlserver"), ("sqlite", "sqlite")):
        if low.startswith(prefix):
            user = re.match(r"\w+://([^:@/]*)(?::([^@]*))?@", dsn)
            rest = re.sub(r"^\w+:(//)?([^@/]*@)?", "", dsn)
            return {"url": f"jdbc:{kind}:{'' if kind == 'sqlite' else '//'}{rest}", **({"user": user[1], "password": user[2] or ""} if user else {})}
    pairs = dict(re.findall(r"(\w[\w ]*?)\s*=\s*([^;\s]+)", dsn))
    keys = {k.lower().strip(): v for k, v in pairs.items()}
    if "server" in keys:
        return {"url": f"jdbc:sqlserver://{keys['server']};databaseName={keys.get('database', '')}", "user": keys.get("user id", keys.get("uid", "")), "password": keys.get("password", keys.get("pwd", ""))}
    if "host" in keys:
        return {"url": f"jdbc:postgresql://{keys['host']}:{keys.get('port', '5432')}/{keys.get('dbname', '')}", "user": keys.get("user", ""), "password": keys.get("password", "")}
    return {"url": f"jdbc:sqlite:{dsn}"}


def masked(dsn: str) -> str:
    import re

    return re.sub(r"(?i)((?:password|pwd)\s*=\s*)[^;\s]+", r"\1***", re.sub(r"(://[^:@/]*):[^@]*@", r"\1:***@", dsn))
