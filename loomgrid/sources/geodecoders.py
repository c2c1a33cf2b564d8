"""Pure decoders of spatial files: bytes to records with a GeoJSON geometry as text."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Iterator

from loomgrid.sources.decoders import Record, decode_text, finite, opened_sqlite, quoted, text_of

RUN_LIMIT, TILE_LIMIT, BLOB_LIMIT = 1 << 20, 5_000_000, 32 << 20


def dump(v: object) -> str:
    return json.dumps(v, ensure_ascii=False, separators=(",", ":"))


def singles(g: dict | None) -> Iterator[dict]:
    if g and g.get("type") == "GeometryCollection":
        for x in g.get("geometries") or []:
            yield from singles(x)
    elif g and g.get("type"):
        yield g


def geojson(raw: bytes) -> Iterator[Record]:
    data = json.loads(decode_text(raw))
    kind = data.get("type")
    features = data.get("features") or [] if kind == "FeatureCollection" else [data] if kind == "Feature" else [{"geometry": data, "properties": {}}]
    for f in features:
        props = {k: text_of(v) for k, v in sorted((f.get("properties") or {}).items())}
        for g in singles(f.get("geometry")):
            yield {"geometry": dump(g), "geometry_type": g["type"], **props}


def _local(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def _child(e: ET.Element, name: str) -> ET.Element | None:
    return next((x for x in e if _local(x) == name), None)


def _text(e: ET.Element, name: str) -> str:
    c = _child(e, name)
    return (c.text or "").strip() if c is not None else ""


def _coords(s: str | None) -> list[list[float]]:
    return [[float(v) for v in p.split(",")[:2]] for p in (s or "").split() if p.count(",")]


def _kml_geometry(e: ET.Element) -> dict | None:
    kind = _local(e)
    if kind == "MultiGeometry":
        return {"type": "GeometryCollection", "geometries": [g for x in e if (g := _kml_geometry(x))]}
    if kind in ("Point", "LineString"):
        c = _coords(_text(e, "coordinates"))
        return {"type": kind, "coordinates": c[0] if kind == "Point" else c} if c else None
    if kind == "Polygon":
        rings = [_coords(c.text) for side in ("outerBoundaryIs", "innerBoundaryIs") for b in e if _local(b) == side for c in b.iter() if _local(c) == "coordinates"]
        return {"type": "Polygon", "coordinates": rings} if rings and rings[0] else None
    return None


def kml(raw: bytes) -> Iterator[Record]:
    for p in ET.fromstring(raw).iter():
        if _local(p) != "Placemark":
            continue
        g = next((x for e in p if (x := _kml_geometry(e))), None)
        if g:
            extra = {d.get("name", ""): _text(d, "value") for d in p.iter() if _local(d) == "Data"} | {d.get("name", ""): (d.text or "").strip() for d in p.iter() if _local(d) == "SimpleData"}
            yield {"geometry": dump(g), "geometry_type": g["type"], "name": _text(p, "name"), "description": _text(p, "description"), "style_url": _text(p, "styleUrl"), **dict(sorted(extra.items()))}


def gpx(raw: bytes) -> Iterator[Record]:
    at = lambda e: [float(e.get("lon")), float(e.get("lat"))]

    def row(kind: str, e: ET.Element, g: dict) -> Record:
        rest = {_local(x): (x.text or "").strip() for x in e if not len(x) and _local(x) not in ("name", "desc", "time")}
        return {"record_type": kind, "name": _text(e, "name"), "description": _text(e, "desc"), "time": _text(e, "time"), "geometry": dump(g), "geometry_type": g["type"], "properties": dump(rest)}

    for e in ET.fromstring(raw):
        if _local(e) == "wpt":
            yield row("waypoint", e, {"type": "Point", "coordinates": at(e)})
        elif _local(e) == "rte" and len(p := [at(x) for x in e if _local(x) == "rtept"]) > 1:
            yield row("route", e, {"type": "LineString", "coordinates": p})
        elif _local(e) == "trk":
            segs = [s for seg in e if _local(seg) == "trkseg" and len(s := [at(x) for x in seg if _local(x) == "trkpt"]) > 1]
            if segs:
                yield row("track", e, {"type": "LineString", "coordinates": segs[0]} if len(segs) == 1 else {"type": "MultiLineString", "coordinates": segs})


def osm_objects(raw: bytes) -> Iterator[tuple[str, str, float | None, float | None, list[str], dict[str, str]]]:
    """(kind, id, lon, lat, refs, tags) of nodes, ways and relations, in file order."""
    for e in ET.fromstring(raw):
        if e.tag in ("node", "way", "relation"):
            tags = {t.get("k"): t.get("v") for t in e.iterfind("tag")}
            yield e.tag, e.get("id"), finite(e.get("lon")), finite(e.get("lat")), [n.get("ref") for n in e.iterfind("nd")], tags


class Proto:
    """Fields of one protocol buffer message: number -> values (numbers, or bytes)."""

    def __init__(self, raw: bytes):
        self.f: dict[int, list] = {}
        at = 0
        while at < len(raw):
            key, at = varint(raw, at)
            wire = key & 7
            if wire == 0:
                v, at = varint(raw, at)
            elif wire == 2:
                n, at = varint(raw, at)
                v, at = raw[at : at + n], at + n
            elif wire in (1, 5):
                n = 8 if wire == 1 else 4
                v, at = raw[at : at + n], at + n
            else:
                raise ValueError("a protocol buffer has an unknown wire type")
            self.f.setdefault(key >> 3, []).append(v)

    def one(self, n: int, default: object = None) -> object:
        return self.f.get(n, [default])[0]

    def packed(self, n: int, signed: bool = False) -> list[int]:
        out = []
        for v in self.f.get(n, []):
            if isinstance(v, int):
                out.append(v)
            else:
                at = 0
                while at < len(v):
                    x, at = varint(v, at)
                    out.append(x)
        return [zigzag(x) for x in out] if signed else out


def varint(raw: bytes, at: int) -> tuple[int, int]:
    v = shift = 0
    while True:
        b = raw[at]
        at += 1
        v |= (b & 127) << shift
        if b < 128:
            return v, at
        shift += 7


def zigzag(x: int) -> int:
    return x >> 1 ^ -(x & 1)


def running(deltas: list[int]) -> list[int]:
    out, total = [], 0
    for d in deltas:
        total += d
        out.append(total)
    return out


def osm_pbf_objects(raw: bytes) -> Iterator[tuple[str, str, float | None, float | None, list[str], dict[str, str]]]:
    at = 0
    while at < len(raw):
        n = struct.unpack(">I", raw[at : at + 4])[0]
        head = Proto(raw[at + 4 : at + 4 + n])
        size = head.one(3)
        blob = Proto(raw[at + 4 + n : at + 4 + n + size])
        at += 4 + n + size
        if head.one(1) != b"OSMData":
            continue
        if (data := blob.one(1)) is None:
            d = zlib.decompressobj()
            data = d.decompress(blob.one(3), BLOB_LIMIT)
            if d.unconsumed_tail:
                raise ValueError("a blob is larger than the limit")
        block = Proto(data)
        strings = [s.decode("utf-8", "replace") for s in Proto(block.one(1, b"")).f.get(1, [])]
        gran, lat0, lon0 = block.one(17, 100), block.one(19, 0), block.one(20, 0)
        place = lambda v, base: round((base + gran * v) * 1e-9, 9)
        tags = lambda p: {strings[k]: strings[v] for k, v in zip(p.packed(2), p.packed(3))}
        for group in map(Proto, block.f.get(2, [])):
            for p in map(Proto, group.f.get(1, [])):
                yield "node", str(zigzag(p.one(1))), place(zigzag(p.one(9)), lon0), place(zigzag(p.one(8)), lat0), [], tags(p)
            for p in map(Proto, group.f.get(2, [])):
                kv, k = p.packed(10), 0
                for i, la, lo in zip(running(p.packed(1, True)), running(p.packed(8, True)), running(p.packed(9, True))):
                    own = {}
                    while k < len(kv) and kv[k]:
                        own[strings[kv[k]]] = strings[kv[k + 1]]
                        k += 2
                    k += 1
                    yield "node", str(i), place(lo, lon0), place(la, lat0), [], own
            for p in map(Proto, group.f.get(3, [])):
                yield "way", str(p.one(1)), None, None, [str(x) for x in running(p.packed(8, True))], tags(p)


def wkb(raw: bytes, at: int = 0) -> tuple[dict, int]:
    """GeoJSON of a WKB geometry (types 1 to 7, Z and M dropped) and where it ends."""
    e = "<" if raw[at] else ">"
    code = struct.unpack_from(e + "I", raw, at + 1)[0]
    kind, dims = (code & 0xFFFF) % 1000, 2
    dims += sum((bool(code & 0x80000000) or (code & 0xFFFF) // 1000 in (1, 3), bool(code & 0x40000000) or (code & 0xFFFF) // 1000 in (2, 3)))
    at += 5 + (4 if code & 0x20000000 else 0)

    def count() -> int:
        nonlocal at
        at += 4
        return struct.unpack_from(e + "I", raw, at - 4)[0]

    def point() -> list[float]:
        nonlocal at
        at += 8 * dims
        return list(struct.unpack_from(f"{e}{dims}d", raw, at - 8 * dims)[:2])

    if kind == 1:
        return {"type": "Point", "coordinates": point()}, at
    if kind == 2:
        return {"type": "LineString", "coordinates": [point() for _ in range(count())]}, at
    if kind == 3:
        return {"type": "Polygon", "coordinates": [[point() for _ in range(count())] for _ in range(count())]}, at
    if kind in (4, 5, 6, 7):
        inner = []
        for _ in range(count()):
            g, at = wkb(raw, at)
            inner.append(g)
        if kind == 7:
            return {"type": "GeometryCollection", "geometries": inner}, at
        return {"type": {4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon"}[kind], "coordinates": [g["coordinates"] for g in inner]}, at
    raise ValueError(f"WKB type {code} is not supported")


def gpkg_geometry(raw: bytes | None) -> dict | None:
    if not raw:
        return None
    if raw[:2] == b"GP":
        if raw[3] & 16:
            return None
        raw = raw[8 + {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}[raw[3] >> 1 & 7] :]
    return wkb(raw)[0]


def geopackage(raw: bytes) -> Iterator[Record]:
    with opened_sqlite(raw) as db:
        try:
            layers = db.execute("SELECT table_name, column_name FROM gpkg_geometry_columns ORDER BY 1").fetchall()
        except Exception:  # noqa: BLE001  (an old file without that table)
            layers = []
        layers = layers or [(t, "geom") for (t,) in db.execute("SELECT table_name FROM gpkg_contents WHERE data_type = 'features' ORDER BY 1")]
        for layer, column in layers:
            cur = db.execute(f"SELECT * FROM {quoted(layer)}")
            cols = [c[0] for c in cur.description]
            for row in cur:
                rec = dict(zip(cols, row))
                g = gpkg_geometry(rec.pop(column, None))
                fid = rec.get("fid", rec.get("id", row[0]))
                yield {"layer": layer, "feature_id": text_of(fid), "geometry": dump(g) if g else None, "geometry_type": g["type"] if g else None, "properties": dump({k: text_of(v) for k, v in rec.items()})}


SHAPES = {1: "Point", 3: "PolyLine", 5: "Polygon", 8: "MultiPoint"}


def shapefile_zip(raw: bytes) -> Iterator[Record]:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        shp = next(n for n in sorted(z.namelist()) if n.lower().endswith(".shp"))
        dbf = next((n for n in z.namelist() if n.lower() == shp[:-4].lower() + ".dbf"), None)
        data, attrs = z.read(shp), list(dbase(z.read(dbf))) if dbf else []
    at, k = 100, 0
    while at + 8 <= len(data):
        number, words = struct.unpack_from(">ii", data, at)
        body = data[at + 8 : at + 8 + 2 * words]
        at += 8 + 2 * words
        code = struct.unpack_from("<i", body)[0]
        kind, g = SHAPES.get(code % 10), None
        if kind == "Point":
            g = {"type": "Point", "coordinates": list(struct.unpack_from("<2d", body, 4))}
        elif kind == "MultiPoint":
            n = struct.unpack_from("<i", body, 36)[0]
            g = {"type": "MultiPoint", "coordinates": [list(struct.unpack_from("<2d", body, 40 + 16 * i)) for i in range(n)]}
        elif kind:
            n, total = struct.unpack_from("<ii", body, 36)
            cuts = [*struct.unpack_from(f"<{n}i", body, 44), total]
            pts = [list(struct.unpack_from("<2d", body, 44 + 4 * n + 16 * i)) for i in range(total)]
            lines = [pts[a:b] for a, b in zip(cuts, cuts[1:])]
            g = {"type": "Polygon", "coordinates": lines} if kind == "Polygon" else {"type": "LineString", "coordinates": lines[0]} if n == 1 else {"type": "MultiLineString", "coordinates": lines}
        yield {"geometry": dump(g) if g else None, "geometry_type": g["type"] if g else None, "shape_id": str(number), "shape_type": str(code), "attributes": dump(attrs[k] if k < len(attrs) else {})}
        k += 1


def dbase(raw: bytes) -> Iterator[dict[str, str]]:
    n, head, size = struct.unpack_from("<IHH", raw, 4)
    fields, at = [], 32
    while at < head - 1 and raw[at] != 13:
        fields.append((raw[at : at + 11].split(b"\0")[0].decode("latin-1"), raw[at + 16]))
        at += 32
    for i in range(n):
        row, p = raw[head + i * size : head + (i + 1) * size], 1
        rec = {}
        for name, width in fields:
            rec[name] = decode_text(row[p : p + width]).strip()
            p += width
        if row[:1] != b"*":
            yield rec


TILE_COLUMNS = ("record_type", "name", "value", "zoom_level", "tile_column", "tile_row", "tile_size", "tile_sha256", "tile_data_base64")


def _tile(z: int, x: int, y: int, data: bytes) -> Record:
    return dict(zip(TILE_COLUMNS, ("tile", None, None, str(z), str(x), str(y), str(len(data)), hashlib.sha256(data).hexdigest(), base64.b64encode(data).decode())))


def _meta(name: str, value: str) -> Record:
    return dict(zip(TILE_COLUMNS, ("metadata", name, value, *[None] * 6)))


def mbtiles(raw: bytes) -> Iterator[Record]:
    with opened_sqlite(raw) as db:
        meta = dict(db.execute("SELECT name, value FROM metadata"))
        meta.setdefault("scheme", "tms")
        for k, v in meta.items():
            yield _meta(k, text_of(v))
        for z, x, y, data in db.execute("SELECT zoom_level, tile_column, tile_row, tile_data FROM tiles ORDER BY 1, 2, 3"):
            yield _tile(z, x, y, data)


def unpack(data: bytes, kind: int) -> bytes:
    if kind in (0, 1):
        return data
    if kind == 2:
        return gzip.decompress(data)
    if kind == 4:
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    raise ValueError("brotli-compressed archives need a brotli decoder, which is not installed")


def hilbert_zxy(tile: int) -> tuple[int, int, int]:
    """Zoom, column and row of a tile number that counts tiles along Hilbert curves, zoom by zoom."""
    z, first = 0, 0
    while tile >= first + 4**z:
        first += 4**z
        z += 1
    d, x, y, s = tile - first, 0, 0, 1
    while s < 1 << z:
        rx = 1 & d >> 1
        ry = 1 & (d ^ rx)
        if not ry:
            if rx:
                x, y = s - 1 - x, s - 1 - y
            x, y = y, x
        x, y, d, s = x + s * rx, y + s * ry, d >> 2, s * 2
    return z, x, y


def pmtiles_entries(raw: bytes) -> list[tuple[int, int, int, int]]:
    """(tile, run, length, offset) of one directory."""
    n, at = varint(raw, 0)
    cols = []
    for _ in range(4):
        col = []
        for _ in range(n):
            v, at = varint(raw, at)
            col.append(v)
        cols.append(col)
    ids, out = running(cols[0]), []
    for i in range(n):
        off = cols[3][i] - 1 if cols[3][i] else out[-1][3] + out[-1][2]
        out.append((ids[i], cols[1][i], cols[2][i], off))
    return out


def pmtiles(raw: bytes) -> Iterator[Record]:
    if raw[:7] != b"PMTiles" or raw[7] != 3:
        raise ValueError("no PMTiles archive of version 3")
    root, root_n, meta, meta_n, leaf, _, data, _ = struct.unpack_from("<8Q", raw, 8)
    inner, _ = raw[97], raw[98]
    info = json.loads(unpack(raw[meta : meta + meta_n], inner) or b"{}") if meta_n else {}
    yield _meta("scheme", "xyz")
    for k, v in info.items():
        yield _meta(k, text_of(v))
    todo, total = [pmtiles_entries(unpack(raw[root : root + root_n], inner))], 0
    while todo:
        for tile, run, length, off in todo.pop():
            if not run:
                todo.append(pmtiles_entries(unpack(raw[leaf + off : leaf + off + length], inner)))
                continue
            total += run
            if run > RUN_LIMIT or total > TILE_LIMIT:
                raise ValueError("the archive names more tiles than the limit")
            for k in range(run):
                yield _tile(*hilbert_zxy(tile + k), raw[data + off : data + off + length])


def routing_graph(raw: bytes) -> Iterator[Record]:
    """An array of edges, or an object of nodes and edges, as the eleven columns of a graph table."""
    data = json.loads(decode_text(raw))
    nodes, edges = (data.get("nodes") or [], data.get("edges") or data.get("links") or []) if isinstance(data, dict) else ([], data)
    pick = lambda x, *names: next((text_of(x[n]) for n in names if x.get(n) is not None), None)

    def row(kind: str, x: dict) -> Record:
        g = x.get("geometry")
        return {
            "record_type": kind, "id": pick(x, "id"), "from_id": pick(x, "from_id", "from", "source", "u"), "to_id": pick(x, "to_id", "to", "target", "v"),
            "lat": pick(x, "lat", "latitude", "y"), "lon": pick(x, "lon", "lng", "longitude", "x"), "cost": pick(x, "cost", "weight", "duration"),
            "distance": pick(x, "distance", "length", "meters"), "geometry": dump(g) if g else None, "geometry_type": g.get("type") if isinstance(g, dict) else None,
            "properties": dump(x.get("properties") or {}),
        }

    yield from (row("node", x) for x in nodes)
    yield from (row("edge", x) for x in edges)
