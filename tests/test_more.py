import base64
import json
from datetime import datetime

import pytest

from loomgrid.functions import fixedwidth, trees
from loomgrid.operators import catalog, charts, tiles, vectors
from loomgrid.plans import history
from loomgrid.sinks import writers as W
from loomgrid.sources import demo, readers


def test_tiles(spark):
    layer = b"\x0a\x05roads"
    mvt = b"\x1a" + bytes([len(layer)]) + layer
    rows = [("metadata", "Scheme", "tms", None, None, None, None, None, None), ("metadata", "minzoom", "1", None, None, None, None, None, None), ("tile", None, None, "1", "0", "1", "9", "h", base64.b64encode(mvt).decode())]
    df = spark.createDataFrame(rows, "record_type string, name string, value string, zoom_level string, tile_column string, tile_row string, tile_size string, tile_sha256 string, tile_data_base64 string")
    assert tiles.is_tile_layer(df) and not tiles.is_routing_graph(df) and tiles.vector_layers(df) == ["roads"]
    assert bytes(W.tile(df, 1, 0, 0).first()["data"]) == mvt and W.tile(df, 1, 0, 1).count() == 0
    assert W.tilejson(df, "u")["minzoom"] == 1
    with pytest.raises(ValueError):
        tiles.metadata(spark.createDataFrame([("metadata", "minzoom", "40")], "record_type string, name string, value string"))


def test_charts(spark):
    df = spark.createDataFrame([("2026-01-02", "a", 1, 5.0), ("2026-01-01", "b", 2, 7.5)], "day string, kind string, user_id int, amount double")
    assert charts.roles(df) == {"day": "time", "kind": "dimension", "user_id": "dimension", "amount": "measure"}
    assert [tuple(r) for r in charts.quick(df).collect()] == [("2026-01-01", 7.5), ("2026-01-02", 5.0)]
    assert charts.from_spec(df, {"x": "KIND", "aggregate": "count"}).count() == 2 and len(charts.result_summary(df)["profile"]) == 4
    with pytest.raises(ValueError):
        charts.checked_spec({"x": "nope"}, df.columns)


def test_trees(spark):
    assert json.loads(spark.createDataFrame([("<a x='1'><b>t</b></a>",)], "v string").select(trees.xml_tree("v")).first()[0]) == {"name": "a", "attributes": {"x": "1"}, "children": [{"name": "b", "text": "t"}]}
    assert trees.preview('{"apiToken": "x", "n": [{"password": 1}]}') == '{"apiToken":"[REDACTED]","n":[{"password":"[REDACTED]"}]}'
    assert trees.preview("postgres://u:pw@h/db") == "postgres://u:[REDACTED]@h/db"


def test_history(spark, tmp_path):
    m = history.Meta(spark, str(tmp_path / "meta"))
    for q in ("SELECT 1", "SELECT 2", "SELECT 1"):
        history.remember_query(m, q)
    assert history.recent_queries(m) == ["SELECT 1", "SELECT 2"]
    for t in ("erp_a", "erp_b", "walk"):
        spark.sql(f"DROP TABLE IF EXISTS {t}")
    spark.createDataFrame([(1, "ACME GmbH")], "id int, name string").write.saveAsTable("erp_a")
    spark.createDataFrame([(7, "acme")], "nr int, firma string").write.saveAsTable("erp_b")
    history.save_config(m, "c", history.MatchConfig("erp_a", "erp_b", "id", "nr", [{"source": "name", "target": "firma", "method": "token_set"}], result="walk"), "30 10 * * *")
    assert history.run_due(m, datetime(2026, 1, 1, 10, 31)) == {} and history.run_due(m, datetime(2026, 1, 1, 10, 30), read_only=True) == {}
    assert history.run_due(m, datetime(2026, 1, 1, 10, 30)) == {"c": "1 rows"}
    assert spark.table("walk").columns == ["source_key", "source_label", "target_key", "target_label", "score", "status", "matched_at"]
    m.drop("match", "c")
    assert m.all("match") == {}
    history.log_event(str(tmp_path / "audit"), "write_dml", "token=abc")
    assert "[REDACTED]" in (tmp_path / "audit").read_text()


def test_demo_and_names(spark):
    assert {n: demo.demo(spark, n).count() for n in ("people", "metrics", "payloads")} == {"people": 10, "metrics": 60, "payloads": 3}
    assert readers.format_of("/x/My File.TSV") == "tsv" and readers.table_name_of("/x/My File.tsv") == "my_file" and W.safe_name("a/b c") == "a_b_c"
    assert readers.jdbc_options("postgres://u:p@h:1/db") == {"url": "jdbc:postgresql://h:1/db", "user": "u", "password": "p"} and readers.masked("postgres://u:p@h") == "postgres://u:***@h"


def test_sql_functions(spark):
    vectors.register_functions(spark)
    assert spark.sql("SELECT vec_cosine_similarity(vec_from_json('[1,0]'), array(1D, 1D)) AS s").first()["s"] == pytest.approx(0.70710678)
    spark.range(1).createOrReplaceTempView("aaa_first")
    catalog.register_context_function(spark)
    assert spark.sql("SELECT line FROM agent_context(200) ORDER BY position").first()["line"] == "aaa_first(id bigint)"


def test_fixed_width_lines(spark):
    lines = spark.createDataFrame([(" 1  Grün   x",), ("22  a b",), ("",), (None,)], "value string")
    spans = fixedwidth.field_spans(lines)
    assert spans == [(1, 2), (5, 4), (12, 1)]
    assert sorted(tuple(r) for r in fixedwidth.split_fields(lines, spans, ["n", "name", "mark"]).collect()) == [("1", "Grün", "x"), ("22", "a b", "")]
    assert fixedwidth.field_spans(lines.where("value = ''")) == []
    with pytest.raises(ValueError):
        fixedwidth.split_fields(lines, spans, ["n"])


def test_profile_sums_small_and_large_numbers(spark):
    from loomgrid.operators.profile import column_profile

    df = spark.createDataFrame([("0.0000001", "1e25", " "), ("0.0000002", "2e25", ""), (None, "3", "x")], "a string, b string, c string")
    got = {r["column"]: r for r in column_profile(df).collect()}
    assert got["b"]["sum"] == pytest.approx(3e25) and got["a"]["sum"] == 0.0000003 and got["a"]["avg"] == 0.00000015 and got["a"]["blanks"] == 1
    assert got["c"]["blanks"] == 1 and got["c"]["distinct"] == 2 and not got["c"]["numeric"]
