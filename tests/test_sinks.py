import json

from loomgrid.operators import geo
from loomgrid.sinks import writers as W
from loomgrid.sources import readers as R


def sample(spark):
    return spark.createDataFrame([(1, "a<b", 1.5, True), (2, None, 2.0, False)], "id long, name string, score double, ok boolean")


def test_round_trips(spark, tmp_path):
    df = sample(spark)
    want = [(1, "a<b", 1.5, True), (2, None, 2.0, False)]
    for name, write in (("x.xml", W.write_xml), ("x.json", W.write_json), ("x.xlsx", W.write_xlsx)):
        p = str(tmp_path / name)
        write(df, p)
        assert [tuple(r) for r in R.read(spark, p).collect()] == want, name
    p = str(tmp_path / "x.db")
    W.write_sqlite(df, p, "t")
    assert [tuple(r)[1:] for r in R.read(spark, p).collect()] == want
    W.write_csv(df, str(tmp_path / "c"))
    assert sorted(tuple(r) for r in R.read(spark, str(tmp_path / "c"), "csv").collect()) == want
    W.write_ndjson(df, str(tmp_path / "n"))
    assert sorted(tuple(r[c] for c in df.columns) for r in R.read(spark, str(tmp_path / "n"), "ndjson").collect()) == want
    W.write_html(df, str(tmp_path / "x.html"))
    assert "a&lt;b" in (tmp_path / "x.html").read_text()


def test_excel_guard(spark):
    df = spark.createDataFrame([("00123",), ("=SUM(1,2)",), ("12.5",), ("a,b",), ("1234567890123456",), ("1/2",), ("-5",)], "v string")
    got = [r[0] for r in df.select(W.excel_cell(df.v)).collect()]
    assert got == ['"=""00123"""', '"=""=SUM(1,2)"""', "12.5", '"a,b"', '"=""1234567890123456"""', '"=""1/2"""', "-5"]


def test_spatial_round_trips(spark, tmp_path):
    df = spark.createDataFrame([("p", 1.0, 2.0), ("q", 3.0, 4.0), ("out", 500.0, 0.0)], "name string, lon double, lat double")
    f = geo.to_features(df)
    for name, write in (("a.geojson", W.write_geojson), ("a.kml", W.write_kml), ("a.gpx", W.write_gpx)):
        p = str(tmp_path / name)
        write(f, p)
        back = R.read_text(spark, p).collect()
        assert [json.loads(r["geometry"])["coordinates"] for r in back] == [[1.0, 2.0], [3.0, 4.0]] and back[0]["name"] == "p", name
    p = str(tmp_path / "a.zip")
    assert W.write_shapefile(f, p) == 0
    back = R.read_text(spark, p).collect()
    assert json.loads(back[1]["geometry"])["coordinates"] == [3.0, 4.0] and json.loads(back[0]["attributes"]) == {"NAME": "p"}
    assert W.geojson_summary(f) == {"features": 2, "types": {"Point": 2}, "bbox": [1.0, 2.0, 3.0, 4.0], "properties": ["name"]}


def test_geometry_pipeline(spark):
    g = '{"type":"MultiLineString","coordinates":[[[0,0],[0.5,0.001],[1,0]],[[50,50],[51,51]]]}'
    df = spark.createDataFrame([(g, "a", "b")], "geometry string, Keep string, gone string")
    out = geo.process(df, "geometry", explode=True, tolerance=0.01, box=geo.parse_bbox("-1,-1,2,2"), fields=["keep", "gone"], drop=["GONE"])
    assert out.columns == ["geometry", "Keep"] and [json.loads(r[0])["coordinates"] for r in out.collect()] == [[[0, 0], [1, 0]]]
    assert geo.hull([(0, 0), (1, 0), (0.5, 0.5), (1, 1), (0, 1)]) == [(0, 0), (1, 0), (1, 1), (0, 1)]
