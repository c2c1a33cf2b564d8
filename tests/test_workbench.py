import json
import time
from datetime import datetime, timedelta

import pytest

from loomgrid.functions import cells, text
from loomgrid.operators import catalog, linkage, profile, routing, sqlgate, vectors
from loomgrid.plans.pipelines import Step, Store
from loomgrid.streaming.watch import Job, Scheduler, Watcher, cron_matches, stream_files, windowed_counts

CLASSES = {
    "SELECT 1": "read_query", "select 1;": "read_query", "SELECT 1; DROP TABLE t": "script", "-- x\nSELECT ';'": "read_query", "WITH a AS (SELECT 1) SELECT * FROM a": "read_query",
    "WITH a AS (DELETE FROM t RETURNING *) SELECT * FROM a": "write_dml", "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a": "write_dml", "EXPLAIN DELETE FROM t": "read_query",
    "EXPLAIN ANALYZE DELETE FROM t": "write_dml", "EXPLAIN (ANALYZE, VERBOSE) DELETE FROM t": "write_dml", "PRAGMA table_info(t)": "read_query", "PRAGMA foreign_keys": "write_dml",
    "SELECT nextval('s')": "write_dml", "SELECT nextval FROM t": "read_query", "CREATE TABLE t(a INT)": "ddl", "CALL p()": "procedure_call", "": "unknown", "foo": "unknown",
    "SELECT E'a\\';b'": "read_query", "SELECT 1 /* ; */ ;": "read_query", "TRUNCATE TABLE t": "write_dml", "DESC t": "read_query",
}


@pytest.mark.parametrize("sql", CLASSES)
def test_classes(sql):
    assert sqlgate.classify(sql) == CLASSES[sql]


def test_gate_and_window(spark):
    spark.range(10).createOrReplaceTempView("loomgrid_ten")
    w = sqlgate.run_window(spark, "SELECT id FROM loomgrid_ten ORDER BY id", 2, 3)
    assert [r[0] for r in w.rows] == [2, 3, 4] and w.has_more
    assert [r[0] for r in sqlgate.run_window(spark, "SELECT id FROM loomgrid_ten WHERE id > ?", args=[8]).rows] == [9]
    with pytest.raises(PermissionError):
        sqlgate.run_window(spark, "DROP TABLE x", gate=sqlgate.Gate(read_only=True))
    with pytest.raises(PermissionError):
        sqlgate.run_window(spark, "WITH a AS (SELECT * FROM sys_users) SELECT * FROM a", gate=sqlgate.Gate(hidden_prefixes=("sys_",)))
    assert sqlgate.sources(spark, "WITH a AS (SELECT * FROM t1) SELECT * FROM a, `t2` WHERE x IN (SELECT y FROM t3)") == ["t1", "t2", "t3"]
    assert sqlgate.target_type("NUMERIC(10,2)", "mssql") == "FLOAT" and sqlgate.type_class("BIT") == "bool" and sqlgate.quote("a.b`c") == "`a`.`b``c`"


def test_kinds(spark):
    values = {"": "blank", "true": "bool", "2026-07-05T21:25:49Z": "datetime", "2026-02-30": "text", "2026-02-28": "date", "23:59": "time", "00123": "text", "-0": "int", "12.5": "float", ".5": "text", "1,5": "text", "+1": "text", "1e3": "float", "99999999999999999999": "text"}
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert {r[0]: r[1] for r in df.select("v", cells.cell_kind(df.v)).collect()} == values
    df = spark.createDataFrame([("1", "x"), ("2.5", "")], "a string, b string")
    assert cells.column_kinds(df) == {"a": "float", "b": "text"} and cells.unique_names(["a b", "a b", ""]) == ["a_b", "a_b_2", "col_3"]
    assert cells.rejected(df, {"a": "int", "b": "text"}).count() == 1


def test_names(spark):
    one = lambda e: spark.range(1).select(e).first()[0]
    lit = __import__("pyspark.sql.functions", fromlist=["lit"]).lit
    for a, b in (("ACME Trading GmbH", "acme trading"), ("Müller Elektro AG", "MUELLER ELEKTRO"), ("Schmidt & Co. KG", "Schmidt")):
        assert one(text.canonical_name(lit(a))) == one(text.canonical_name(lit(b)))
    assert one(text.canonical_name(lit("GmbH"))) == "GMBH"
    assert 0.9 <= text.winkler("MARTHA", "MARHTA") <= 1 and text.winkler("ACME", "TOTALLYDIFFERENT") <= 0.5 and text.winkler("", "") == 1
    codes = {"4006381333931": True, "4006381333930": False, "12345670": True, "12345671": False, "123": False, "1234567x": False}
    assert {c: one(text.ean_valid(lit(c))) for c in codes} == codes
    assert one(text.redact(lit("password=abc; api_key: k1"))) == "password=[REDACTED]; api_key: [REDACTED]"


def test_linkage(spark):
    a = spark.createDataFrame([("S1", "ACME Trading GmbH", "100.00"), ("S2", "Nord Logistik AG", "5"), ("S3", "Unbekannt", "1")], "id string, name string, v string")
    b = spark.createDataFrame([("T1", "acme trading", "102.00"), ("T2", "Nord Logistik", "500"), ("T3", "Other Firm", "1")], "id string, name string, v string")
    m = {(r.source_key, r.target_key): r.status for r in linkage.match(a, b, "ID", "id", [linkage.Rule("name", "name", "token_set")], review=0.5).collect()}
    assert m == {("S1", "T1"): "auto", ("S2", "T2"): "auto"}
    g = [linkage.Rule("name", "name", "similarity", 1, 0, "g"), linkage.Rule("v", "v", "numeric", 1, 0.05, "g")]
    assert [r.source_key for r in linkage.match(a, b, "id", "id", g, review=0.5).collect()] == ["S1"]
    with pytest.raises(ValueError):
        linkage.match(spark.range(2001).selectExpr("string(id) id", "string(id) v"), spark.range(2001).selectExpr("string(id) id", "string(id) v"), "id", "id", [linkage.Rule("v", "v", "exact")])
    assert linkage.suggest_pairs(["name", "address", "id"], ["firm_name", "adress", "id"])[0][:2] == ("address", "adress")


def test_routing(spark):
    nodes = routing.nodes_of(spark.createDataFrame([("a", 0.0, 0.0), ("b", 0.0, 1.0), ("c", 0.0, 2.0)], "id string, lat double, lon double"))
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 5.0), ("a", "zz", 1.0)], "source string, target string, weight double")
    g = routing.edges_of(e, nodes)
    costs = routing.shortest(g, "a")
    assert [x[0] for x in routing.path(costs, "c")] == ["a", "b", "c"] and routing.path(costs, "zz") == []
    assert routing.reachable(g, "a", 2.0).count() == 3
    assert routing.nearest_node(nodes, 1.1, 0.0).first()["id"] == "b"


def test_route_answer(spark):
    nodes = routing.nodes_of(spark.createDataFrame([("a", 0.0, 0.0), ("b", 0.0, 1.0), ("c", 1.0, 2.0), ("d", None, None), ("e", 5.0, 5.0)], "id string, lat double, lon double"))
    e = spark.createDataFrame([("a", "b", 1.0, 70.0), ("b", "c", 1.0, None), ("a", "c", 5.0, 1.0), ("c", "d", 1.0, None)], "source string, target string, weight double, length double")
    g = routing.edges_of(e, nodes)
    r = routing.route(nodes, g, "a", "c").first()
    assert r["node_ids"] == ["a", "b", "c"] and r["edge_count"] == 2 and r["cost"] == 2.0 and 157_000 < r["distance_meters"] < 157_500
    assert r["geometry"] == '{"type":"LineString","coordinates":[[0.0,0.0],[1.0,0.0],[2.0,1.0]]}'
    far = routing.route(nodes, g, "a", "d").first()
    assert far["cost"] == 3.0 and far["distance_meters"] is None and far["geometry"] == r["geometry"]
    here = routing.route(nodes, g, "a", "a").first()
    assert here["edge_count"] == 0 and here["distance_meters"] == 0.0 and here["geometry"] is None
    assert routing.route(nodes, g, "a", "e").count() == 0
    f = routing.reachable_features(nodes, routing.reachable(g, "a", 9.0), 9.0).collect()
    assert sorted(json.loads(x["geometry"])["type"] for x in f) == ["Point", "Point", "Point", "Polygon"]


def test_geometry_members(spark):
    from loomgrid.operators import geo

    cases = {
        '{"type":"Point","bbox":[200,1,200,1],"coordinates":[3,4]}': (True, 3.0),
        '{"type":"LineString","coordinates":[["a",9],[1,2],[3,4]]}': (False, 1.0),
        '{"type":"LineString","coordinates":[[1,2],[3,4]]}': (True, 1.0),
        '{"type":"GeometryCollection","geometries":[{"type":"Point","bbox":[-9,1,200,1],"coordinates":[3,4]}]}': (True, 3.0),
        '{"type":"Point","coordinates":[]}': (False, None),
        "no json": (False, None),
    }
    df = spark.createDataFrame([(k,) for k in cases], "g string")
    assert {r[0]: (r[1], r[2]) for r in df.select("g", geo.is_valid(df.g), geo.bbox(df.g).min_x).collect()} == cases
    ring = [[0, 0], [5, 0.1], [10, 0], [10, 10], [0, 10], [0, 0]]
    assert geo.thin_ring(ring, 1.0) == [[0, 0], [10, 0], [10, 10], [0, 10], [0, 0]]
    triangle = [[0, 0], [5, 0.1], [10, 0], [0, 10], [0, 0]]
    assert geo.thin_ring(triangle, 1.0) == triangle  # three open points would be left
    one = geo.view_bounds(spark.createDataFrame([('{"type":"Point","coordinates":[1,2]}',)], "g string"), "g").first()
    assert tuple(one) == (0.99, 1.99, 1.01, 2.01)


def test_small_texts(spark):
    from pyspark.sql import functions as F

    one = lambda e: spark.range(1).select(e).first()[0]
    assert [one(text.parse_share(F.lit(x), 0.5)) for x in ("60", "0.6", "-1", "900", "", "x")] == [0.6, 0.6, 0.0, 1.0, 0.5, 0.5]
    assert one(text.code_fence_body(F.lit("```sql\nSELECT 1\n```\n"))) == "SELECT 1" and one(text.code_fence_body(F.lit(" SELECT 2 "))) == "SELECT 2"
    assert one(text.has_sql_word(F.lit("drop TABLE t"), "drop")) and not one(text.has_sql_word(F.lit("SELECT dropped"), "drop"))
    assert one(text.trimmed(F.lit(" abcdef "), 3)) == "abc\n[truncated]" and one(text.percent_of(F.lit(5), F.lit(0))) == 0 and one(text.percent_of(F.lit(3), F.lit(2))) == 100
    assert [one(text.byte_size(F.lit(n))) for n in (0, 5, 1024, 1536, 1 << 20)] == ["0 B", "5 B", "1.0 KiB", "1.5 KiB", "1.0 MiB"]


def test_match_limits(spark):
    a = spark.createDataFrame([(i, f"common {i}") for i in range(30)], "id int, name string")
    rule = [linkage.Rule("name", "name", "token_set")]
    assert linkage.match(a, a, "id", "id", rule, review=0.9, max_comparisons=900, max_rows=30).count() == 30
    with pytest.raises(ValueError, match="899 comparisons"):
        linkage.match(a, a, "id", "id", rule, max_comparisons=899)
    with pytest.raises(ValueError, match="over 29 rows"):
        linkage.match(a, a, "id", "id", rule, max_rows=29)


def test_ddl(spark):
    spark.sql("DROP VIEW IF EXISTS made_view")
    spark.sql("DROP TABLE IF EXISTS made_table")
    catalog.create_table(spark, "made_table", {"a.b": "VARCHAR(20)", "ID": "text", "v": "NUMERIC(10,2)"})
    assert [(f.name, f.dataType.simpleString()) for f in spark.table("made_table").schema] == [("id", "bigint"), ("a.b", "string"), ("v", "double")]
    catalog.create_view(spark, "made_view", "SELECT id FROM made_table;")
    assert catalog.view_script(spark, "made_view", alter=True) == "ALTER VIEW `made_view` AS SELECT id FROM made_table"
    with pytest.raises(PermissionError):
        catalog.create_view(spark, "made_view", "DELETE FROM made_table", replace=True)
    with pytest.raises(ValueError):
        catalog.view_script(spark, "made_table")
    spark.sql("DROP VIEW made_view")
    catalog.drop_table(spark, "made_table")
    assert not spark.catalog.tableExists("made_table")


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0])], "id int, v array<double>")
    assert [(r["id"], r["_vec_rank"]) for r in vectors.top_k(df, "v", [1.0, 0.0], 1, order="id").collect()] == [(1, 1)]


def test_log_roles():
    assert profile.log_roles(["created", "severity", "msg", "x"]) == ("created", "severity", "msg")


def test_pipelines(spark, tmp_path):
    spark.createDataFrame([(1, "n"), (2, "n")], "id int, region string").createOrReplaceTempView("pipeline_rows")
    s = Store(spark, str(tmp_path / "p"))
    assert s.save("P", [Step("one", "SELECT region, count(*) AS n FROM pipeline_rows GROUP BY region")]) == 1
    assert s.save("P", [Step("one", "SELECT * FROM pipeline_rows"), Step("two", "SELECT no_such FROM pipeline_rows")]) == 2
    status, lineage = s.run("P", 1)
    assert status == "succeeded" and lineage[0].sources == ["pipeline_rows"] and lineage[0].row_count == 1 and lineage[0].columns == ["region", "n"]
    status, lineage = s.run("P")
    assert status == "failed" and [x.status for x in lineage] == ["succeeded", "failed"] and s.runs("P").count() == 2
    other = Store(spark, str(tmp_path / "q"))
    assert other.load_bundle(s.export()) == 1 and other.load_bundle(s.export()) == 0
    s.delete("P")
    assert s.latest().count() == 0 and s.runs("P").count() == 2
    with pytest.raises(ValueError):
        s.save("bad", [Step("x", "DELETE FROM t")])


def test_catalog(spark):
    spark.sql("DROP TABLE IF EXISTS edit_me")
    spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string").write.saveAsTable("edit_me")
    assert catalog.insert(spark, "edit_me", {"v": "c"}) == 3
    catalog.update(spark, "edit_me", 2, {"v": "z"})
    catalog.delete(spark, "edit_me", 1)
    assert sorted(tuple(r) for r in spark.table("edit_me").collect()) == [(2, "z"), (3, "c")] and catalog.row_count(spark, "edit_me") == 2
    assert "edit_me" in [r["name"] for r in catalog.objects(spark).collect()] and catalog.schema_context(spark, "show edit_me v")[0]["table"] == "edit_me"
    assert catalog.dependencies(spark, {"w": "SELECT * FROM edit_me"}).collect()[0]["uses"] == "edit_me"


def test_watch_and_jobs(spark, tmp_path):
    spark.sql("DROP TABLE IF EXISTS drop_in")
    (tmp_path / "drop_in.csv").write_text("a,b\n1,x\n")
    w = Watcher(spark, str(tmp_path))
    assert w.poll() == ["drop_in"] and w.poll() == []
    time.sleep(0.05)
    (tmp_path / "drop_in.csv").write_text("a,b\n1,x\n2,y\n")
    assert w.poll() == ["drop_in"] and spark.table("drop_in").count() == 2
    now = datetime(2026, 3, 2, 10, 30)
    assert cron_matches("*/15 9-17 * * 1-5", now) and not cron_matches("0 * * * *", now)
    s = Scheduler(spark)
    s.add(Job("i", lambda x: x.range(3).count(), "INTERVAL", every=timedelta(minutes=5)))
    assert s.tick(now) == ["i"] and s.tick(now + timedelta(minutes=1)) == [] and s.tick(now + timedelta(minutes=6)) == ["i"]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("2026-01-01 00:10:00,x\n2026-01-01 00:20:00,x\n2026-01-01 01:10:00,y\n")
    df = windowed_counts(stream_files(spark, str(tmp_path / "in"), "ts timestamp, k string"), "ts", "k")
    q = df.writeStream.format("memory").queryName("loomgrid_counts").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(60)
    assert sorted((r.k, r.n) for r in spark.table("loomgrid_counts").collect()) == [("x", 2), ("y", 1)]
