import io
import json
import sqlite3
import struct
import tracemalloc
import zipfile
import zlib

import pytest

from loomgrid.sinks import writers as W
from loomgrid.sources import decoders as D
from loomgrid.sources import geodecoders as G
from loomgrid.sources import readers as R


def put(tmp_path, name, data):
    p = tmp_path / name
    p.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(p)


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_csv_types_and_encodings(spark, tmp_path):
    p = put(tmp_path, "a.csv", "nr,weight,sold,seen,shelf\n7,0.75,false,2024-02-29T08:00:01Z,0042\n8,3.5,true,2024-03-01T23:59:59Z,0007\n")
    df = R.read(spark, p)
    assert dict(df.dtypes) == {"nr": "bigint", "weight": "double", "sold": "boolean", "seen": "timestamp", "shelf": "string"}
    assert rows(df)[0]["shelf"] == "0042"
    assert rows(R.read(spark, put(tmp_path, "u.csv", "title,pages\nIris,81\n".encode("utf-16")))) == [{"title": "Iris", "pages": 81}]
    assert rows(R.read(spark, put(tmp_path, "l.csv", b"plant,place\nOrchid\xe9e,K\xf6ln\n")))[0] == {"plant": "Orchidée", "place": "Köln"}
    assert rows(R.read(spark, put(tmp_path, "t.tsv", "a\tb\n1\t2\n"))) == [{"a": 1, "b": 2}]


def test_csv_with_line_breaks_in_cells(spark, tmp_path):
    """Quoted newlines, quotes and separators come back as one cell; a file without them stays splittable."""
    p = put(tmp_path, "q.csv", 'n,remark\n1,"first line\nsecond ""line"", with comma"\n2,plain\n')
    assert rows(R.read(spark, p)) == [{"n": 1, "remark": 'first line\nsecond "line", with comma'}, {"n": 2, "remark": "plain"}]


def test_text_formats(spark, tmp_path):
    assert rows(R.read(spark, put(tmp_path, "a.json", '[{"a":1,"b":{"x":2}},{"a":null,"c":"z"}]'))) == [{"a": 1, "b": '{"x":2}', "c": None}, {"a": None, "b": None, "c": "z"}]
    assert rows(R.read(spark, put(tmp_path, "a.ndjson", '{"a":1}\n{"a":2.5}\n'))) == [{"a": 1.0}, {"a": 2.5}]
    assert rows(R.read(spark, put(tmp_path, "a.toml", "[[item]]\nn=1\n[[item]]\nn=2\n"))) == [{"n": 1}, {"n": 2}]
    assert rows(R.read(spark, put(tmp_path, "a.ini", "k=v\n[s]\n;c\na: 'b'\n"))) == [{"section": "(default)", "k": "v", "a": None}, {"section": "s", "k": None, "a": "b"}]
    assert rows(R.read(spark, put(tmp_path, "a.txt", "name   age\nAda L   37\nBob      5\n"))) == [{"name": "Ada L", "age": 37}, {"name": "Bob", "age": 5}]
    assert rows(R.read(spark, put(tmp_path, "a.html", "<table><tr><th>a</th></tr><tr><td>x<br>&amp;</td></tr></table>")))[1]["col_1"] == "x\n&"
    assert rows(R.read(spark, put(tmp_path, "a.xml", '<result><columns><column name="a"/></columns><rows><row><cell name="a">7</cell></row></rows></result>'))) == [{"a": 7}]
    assert rows(R.read(spark, put(tmp_path, "a.ics", "BEGIN:VEVENT\r\nSUMMARY:Long\r\n er\r\nDTSTART;TZID=X:20260101\r\nEND:VEVENT\r\n")))[0]["summary"] == "Longer"
    assert rows(R.read(spark, put(tmp_path, "a.vcf", "BEGIN:VCARD\nFN:Ada\nEMAIL:a@x\nEMAIL:b@x\nEND:VCARD\n")))[0]["email"] == "a@x; b@x"


def test_binary_formats(spark, tmp_path):
    assert rows(R.read(spark, put(tmp_path, "a.msgpack", b"\x91\x82\xa5title\xa4Iris\xa5pages\x51"))) == [{"title": "Iris", "pages": 81}]
    assert rows(R.read(spark, put(tmp_path, "a.cbor", b"\x81\xa2\x65title\x64Iris\x65pages\x18\x51"))) == [{"title": "Iris", "pages": 81}]
    body = b"\x02title\0\x05\0\0\0Iris\0\x10pages\0\x51\0\0\0"
    assert rows(R.read(spark, put(tmp_path, "a.bson", struct.pack("<i", len(body) + 5) + body + b"\0"))) == [{"title": "Iris", "pages": 81}]
    db = sqlite3.connect(str(tmp_path / "a.db"))
    db.executescript("CREATE TABLE t(a INT); INSERT INTO t VALUES (1); CREATE TABLE u(b TEXT); INSERT INTO u VALUES ('x')")
    db.commit()
    assert rows(R.read(spark, str(tmp_path / "a.db"))) == [{"source_table": "t", "a": 1, "b": None}, {"source_table": "u", "a": None, "b": "x"}]
    assert rows(R.read_manifest(spark, put(tmp_path, "a.arrow", b"ARROW1abc"), "arrow"))[0]["magic"] == b"ARROW1abc".hex()
    with pytest.raises(ValueError):
        list(D.cbor(b"\xc0\x01"))


def test_spatial_formats(spark, tmp_path):
    fc = {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": [1, 2]}, {"type": "Point", "coordinates": [3, 4]}]}, "properties": {"z": 1, "a": "q"}}]}
    df = R.read(spark, put(tmp_path, "a.geojson", json.dumps(fc)))
    assert df.columns == ["geometry", "geometry_type", "a", "z"] and df.count() == 2
    kml = "<kml><Placemark><name>n</name><Point><coordinates>1,2,0</coordinates></Point></Placemark><Placemark><name>none</name></Placemark></kml>"
    assert [r["name"] for r in rows(R.read(spark, put(tmp_path, "a.kml", kml)))] == ["n"]
    gpx = '<gpx><wpt lat="2" lon="1"><name>w</name></wpt><trk><trkseg><trkpt lat="0" lon="0"/><trkpt lat="1" lon="1"/></trkseg></trk></gpx>'
    assert [r["record_type"] for r in rows(R.read(spark, put(tmp_path, "a.gpx", gpx)))] == ["waypoint", "track"]
    osm = '<osm><node id="1" lon="0" lat="0"><tag k="amenity" v="bar"/></node><node id="2" lon="1" lat="0"/><node id="3" lon="1" lat="1"/><way id="9"><nd ref="1"/><nd ref="2"/><nd ref="3"/><nd ref="1"/></way></osm>'
    got = {r["osm_id"]: r["geometry_type"] for r in rows(R.read_text(spark, put(tmp_path, "a.osm", osm)))}
    assert got == {"1": "Point", "9": "Polygon"}
    graph = {"nodes": [{"id": "a", "lat": 1, "lng": 2}], "edges": [{"source": "a", "target": "b", "weight": 3}]}
    g = list(G.routing_graph(json.dumps(graph).encode()))
    assert g[0]["lon"] == "2" and g[1]["cost"] == "3" and g[1]["to_id"] == "b"


def test_tiles_and_wkb():
    assert [G.hilbert_zxy(i) for i in range(6)] == [(0, 0, 0), (1, 0, 0), (1, 0, 1), (1, 1, 1), (1, 1, 0), (2, 0, 0)]
    assert G.wkb(b"\x01" + struct.pack("<I2d", 1, 3, 4))[0] == {"type": "Point", "coordinates": [3.0, 4.0]}
    entries = bytes([1, 0, 2, 3, 1])  # one entry: tile 0, run 2, length 3, offset 0
    meta = b"{}"
    head = b"PMTiles\x03" + struct.pack("<8Q", 127, len(entries), 127 + len(entries), len(meta), 0, 0, 127 + len(entries) + len(meta), 3)
    raw = head.ljust(97, b"\0") + b"\x01\x01" + bytes(28) + entries + meta + b"abc"
    tiles = [r for r in G.pmtiles(raw) if r["record_type"] == "tile"]
    assert [(t["zoom_level"], t["tile_column"], t["tile_row"]) for t in tiles] == [("0", "0", "0"), ("1", "0", "0")] and tiles[0]["tile_size"] == "3"


def test_osm_pbf():
    def v(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def f(k, data):
        return v(k << 3 | 2) + v(len(data)) + data

    strings = f(1, b"") + f(1, b"name") + f(1, b"x")
    zz = lambda n: v(n << 1 if n >= 0 else (-n << 1) - 1)
    dense = f(1, zz(5) + zz(1)) + f(8, zz(10) + zz(5)) + f(9, zz(20) + zz(5)) + f(10, v(1) + v(2) + v(0) + v(0))
    block = f(1, strings) + f(2, f(2, dense))
    blob = f(3, zlib.compress(block))
    head = f(1, b"OSMData") + v(3 << 3) + v(len(blob))
    raw = struct.pack(">I", len(head)) + head + blob
    got = list(G.osm_pbf_objects(raw))
    assert got[0][:2] == ("node", "5") and got[0][5] == {"name": "x"} and got[1][1] == "6" and got[1][2] == pytest.approx(2.5e-06)


def test_xlsx_sheets():
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="A" r:id="r1"/><sheet name="B" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/1.xml"/><Relationship Id="r2" Target="worksheets/2.xml"/></Relationships>')
        for n, val in ((1, 5), (2, 6)):
            z.writestr(f"xl/worksheets/{n}.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="inlineStr"><is><t>n</t></is></c></row><row><c r="A2"><v>{val}</v></c></row></sheetData></worksheet>')
    assert list(D.xlsx(b.getvalue())) == [{"sheet": "A", "n": "5"}, {"sheet": "B", "n": "6"}]


def test_xlsx_parts_of_any_size(monkeypatch):
    """Sheets and shared strings above the limit of parts that are read whole come back in full, and take the memory of a row at a time."""
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    n, b = 20_000, io.BytesIO()
    with zipfile.ZipFile(b, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="none" r:id="r1"/><sheet name="all" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/1.xml"/><Relationship Id="r2" Target="/xl/worksheets/2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>id</t></si><si><t>größe</t></si><si><t/></si>" + "\n".join(f"<si><r><t>run {i}</t></r><r><t xml:space='preserve'> &amp;\nmore </t></r></si>" for i in range(n)) + "</sst>")
        z.writestr("xl/worksheets/1.xml", f'<worksheet {ns}><sheetData/></worksheet>')
        body = "\n".join(f'  <row r="{i + 2}"><c r="A{i + 2}"><v>{i}</v></c><c r="C{i + 2}" t="s"><v>{i + 3 if i % 2 else 2}</v></c></row>' for i in range(n))
        z.writestr("xl/worksheets/2.xml", f'<worksheet {ns}><cols><col min="1" max="3"/></cols><sheetData><row><c t="s"><v>0</v></c><c/><c t="s"><v>1</v></c></row>{body}</sheetData><mergeCells><mergeCell ref="A1:B1"/></mergeCells></worksheet>')
    monkeypatch.setattr(D, "ENTRY_LIMIT", 1_000)
    tracemalloc.start()
    try:
        for i, rec in enumerate(D.xlsx(b.getvalue())):
            assert rec == {"id": str(i), "col_2": "", "größe": f"run {i} &\nmore " if i % 2 else ""}
        assert i == n - 1 and tracemalloc.get_traced_memory()[1] < 4 << 20
    finally:
        tracemalloc.stop()


def test_xlsx_sheet_above_128_mib(tmp_path):
    """What the sink writes beyond 128 MiB of a sheet is read back whole."""

    class Rows:
        columns = ["id", "note"]

        def toLocalIterator(self):
            return ((i, f"{i}" + "x" * 30_000) for i in range(4_500))

    p = tmp_path / "wide.xlsx"
    W.write_xlsx(Rows(), str(p))
    with zipfile.ZipFile(p) as z:
        assert z.getinfo("xl/worksheets/sheet1.xml").file_size > 128 << 20
    got = [(r["id"], r["note"][:4], len(r["note"])) for r in D.xlsx(p.read_bytes())]
    assert got == [(str(i), f"{i}xxx"[:4], 30_000 + len(str(i))) for i in range(4_500)]
