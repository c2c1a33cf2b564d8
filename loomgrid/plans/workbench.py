"""Queries over cell kinds, profiles, charts, text functions and record linkage, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.functions import cells, text
from loomgrid.operators import linkage, profile
from loomgrid.session import table


def _order_cells(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.when(F.col("o_orderkey") % 7 == 0, "").when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey").cast("string")).otherwise(F.format_string("%.2f", "o_totalprice")).alias("amount"),
        F.when(F.col("o_orderkey") % 2 == 0, "true").otherwise("FALSE").alias("flag"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("stamp"),
        F.lpad(F.col("o_custkey").cast("string"), 6, "0").alias("code"),
    )


def cell_kinds(spark: SparkSession, d: str) -> DataFrame:
    c = profile.cells(_order_cells(spark, d))
    return c.groupBy("column", cells.cell_kind(F.col("value")).alias("kind")).agg(F.count("*").alias("n"))


def infer_columns(spark: SparkSession, d: str) -> DataFrame:
    kinds = cells.column_kinds(_order_cells(spark, d))
    return spark.createDataFrame(sorted(kinds.items()), "column string, kind string")


def column_profile(spark: SparkSession, d: str) -> DataFrame:
    got = profile.column_profile(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", F.round("o_totalprice", 2).alias("price")))
    return got.withColumn("sum", F.round("sum", 4)).withColumn("avg", F.round("avg", 4))


def column_ranges(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.when(F.col("o_orderkey") % 5 == 0, " ").otherwise(F.col("o_orderpriority")).alias("o_orderpriority"))
    return profile.column_ranges(o).withColumn("avg", F.round("avg", 4)).withColumn("examples", F.array_join("examples", ", "))


def log_view(spark: SparkSession, d: str) -> DataFrame:
    """The last lines by id that name a user whose id starts with 1."""
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("severity"), F.concat(F.lit("user "), F.coalesce(F.col("user_id").cast("string"), F.lit("?"))).alias("msg"))
    return profile.log_view(e, "id", "USER 1")


def score_percents(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    key = F.col("p_partkey")
    share = F.when(key % 7 == 0, "x").otherwise((key % 160 - 10).cast("string"))
    return p.select("p_partkey", text.score_percent(key % 1001 / F.lit(1000.0)).alias("percent"), F.round(text.parse_share(share, 0.25), 4).alias("share"))


def byte_sizes(spark: SparkSession, d: str) -> DataFrame:
    n = F.octet_length("text").cast("long")
    return table(spark, d, "documents").select("doc_id", text.byte_size(n).alias("size"), text.byte_size(n * n * n).alias("cube"), text.percent_of(n, F.lit(4096)).alias("percent"))


def top_values(spark: SparkSession, d: str) -> DataFrame:
    return profile.top_values(table(spark, d, "orders").select("o_orderstatus", "o_orderpriority", "o_custkey")).withColumn("rank", F.col("rank").cast("long"))


def pivot_summary(spark: SparkSession, d: str) -> DataFrame:
    return profile.pivot_summary(table(spark, d, "part").select("p_brand", "p_size", "p_retailprice"), "p_brand", ["p_size", "p_retailprice"])


def quick_chart(spark: SparkSession, d: str) -> DataFrame:
    return profile.chart(table(spark, d, "events"), "event_type", "value", "sum")


def spec_chart_avg(spark: SparkSession, d: str) -> DataFrame:
    return profile.chart(table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "value"), "day", "value", "avg", by_time=True)


def log_lines(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), F.col("event_type").alias("status"), F.col("props").alias("message"), "user_id")
    return profile.log_lines(e, *profile.log_roles(e.columns))


def canonical_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", text.canonical_name(F.concat_ws(" ", F.lit("Müller & Söhne"), "p_name", F.lit("GmbH"))).alias("name"))


def house_numbers(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    a = F.concat(F.regexp_replace("c_name", "[^A-Za-z]", ""), F.lit("str. "), (F.col("c_custkey") % 90).cast("string"), F.when(F.col("c_custkey") % 4 == 0, "b").otherwise(""))
    b = F.concat(F.regexp_replace("c_name", "[^A-Za-z]", ""), F.lit("straße "), (F.col("c_custkey") % 45).cast("string"), F.when(F.col("c_custkey") % 4 == 0, "B").otherwise(""))
    return c.select("c_custkey", text.house_number(a).alias("number"), F.round(text.address_score(a, b), 6).alias("score"))


def numeric_scores(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    a = F.concat(F.col("p_partkey").cast("string"), F.lit(",5"))
    b = F.concat((F.col("p_partkey") + F.col("p_partkey") % 7).cast("string"), F.lit(".5 "))
    return p.select("p_partkey", F.round(text.numeric_score(a, b, 0.05), 4).alias("score"))


def ean_codes(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", F.lpad((F.col("p_partkey") * 7919).cast("string"), 13, "4").alias("code"))
    return p.select("p_partkey", "code", text.ean_valid(F.col("code")).alias("valid"))


def _names(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """All parts against all parts: names with a legal form, and with more words where the size is a multiple of five, against names in capitals."""
    p = table(spark, d, "part")
    a = p.select(F.col("p_partkey").alias("id"), F.concat("p_name", F.when(F.col("p_size") % 5 == 0, " imported special edition").otherwise(""), F.lit(" GmbH")).alias("name"), "p_size")
    b = p.select(F.col("p_partkey").alias("kdnr"), F.upper("p_name").alias("firma"), "p_size")
    return a, b


def match_token_set(spark: SparkSession, d: str) -> DataFrame:
    a, b = _names(spark, d)
    m = linkage.match(a, b, "id", "KDNR", [linkage.Rule("name", "firma", "token_set")], review=0.5)
    return m.withColumn("score", F.round("score", 6))


def match_grouped(spark: SparkSession, d: str) -> DataFrame:
    """A name, and a group of name and size that vetoes together."""
    a, b = _names(spark, d)
    rules = [linkage.Rule("name", "firma", "token_set", 2.0), linkage.Rule("p_size", "p_size", "numeric", 1.0, 0.5, "g"), linkage.Rule("name", "firma", "normalized", 1.0, 0.0, "g")]
    return linkage.match(a, b, "id", "kdnr", rules, auto=0.9, review=0.4).withColumn("score", F.round("score", 6))


def match_stats(spark: SparkSession, d: str) -> DataFrame:
    a, b = _names(spark, d)
    return linkage.match_stats(a, "id", linkage.match(a, b, "id", "kdnr", [linkage.Rule("name", "firma", "token_set")], review=0.5))


def jaro_winkler(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_name").alias("a"))
    r = n.select(F.col("a").alias("b"))
    return n.crossJoin(F.broadcast(r)).select("a", "b", F.round(text.jaro_winkler("a", "b"), 6).alias("score"))  # nation has 25 rows at every scale


QUERIES = {
    f.__name__: f
    for f in (
        cell_kinds, infer_columns, column_profile, column_ranges, log_view, score_percents, byte_sizes, top_values, pivot_summary, quick_chart, spec_chart_avg, log_lines, canonical_names,
        house_numbers, numeric_scores, ean_codes, match_token_set, match_grouped, match_stats, jaro_winkler,
    )
}

_MARKS = f"translate(%s, '{text.MARKED}', '{text.PLAIN}')"
_FORMS = "[" + ", ".join(f"'{x}'" for x in text.LEGAL_FORMS) + "]"


def _tokens(e: str) -> str:
    up = f"replace(replace(replace(upper(regexp_replace({_MARKS % e}, '[^\\p{{L}}\\p{{Nd}}]', ' ', 'g')), 'AE', 'A'), 'OE', 'O'), 'UE', 'U')"
    all_ = f"list_filter(string_split({up}, ' '), lambda x: x <> '')"
    return f"CASE WHEN len(list_filter({all_}, lambda x: NOT list_contains({_FORMS}, x))) > 0 THEN list_filter({all_}, lambda x: NOT list_contains({_FORMS}, x)) ELSE {all_} END"


_CELLS = """
WITH src AS (SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders),
c AS (
  SELECT 'id' AS "column", CAST(o_orderkey AS VARCHAR) AS v, 'int' AS kind FROM src
  UNION ALL SELECT 'amount', '', CASE WHEN o_orderkey % 7 = 0 THEN 'blank' WHEN o_orderkey % 3 = 0 THEN 'int' ELSE 'float' END FROM src
  UNION ALL SELECT 'flag', '', 'bool' FROM src
  UNION ALL SELECT 'day', '', 'date' FROM src
  UNION ALL SELECT 'stamp', '', 'datetime' FROM src
  UNION ALL SELECT 'code', '', CASE WHEN o_custkey >= 100000 THEN 'int' ELSE 'text' END FROM src)
"""
_NAMES = """
a AS (SELECT CAST(p_partkey AS VARCHAR) AS s, p_name || CASE WHEN p_size %% 5 = 0 THEN ' imported special edition' ELSE '' END || ' GmbH' AS name, p_size FROM part),
b AS (SELECT CAST(p_partkey AS VARCHAR) AS t, upper(p_name) AS firma, p_size FROM part),
ta AS (SELECT s, p_size, list_distinct(%s) AS x FROM a), tb AS (SELECT t, p_size, list_distinct(%s) AS y FROM b),
pairs AS (SELECT s, t, ta.p_size AS p, tb.p_size AS q, x, y, len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) AS j FROM ta JOIN tb ON len(list_filter(list_intersect(x, y), lambda z: strlen(z) >= 3)) > 0)
""" % (_tokens("name"), _tokens("firma"))

ORACLES = {
    "cell_kinds": _CELLS + """SELECT "column", kind, count(*) AS n FROM c GROUP BY 1, 2""",
    "infer_columns": _CELLS + """SELECT "column", CASE WHEN count(DISTINCT kind) = 1 THEN min(kind) WHEN list_sort(list(DISTINCT kind)) = ['float', 'int'] THEN 'float' ELSE 'text' END AS kind
        FROM c WHERE kind <> 'blank' GROUP BY 1""",
    "column_profile": " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) AS rows, count(*) - count({e}) AS blanks, count(DISTINCT {e}) AS "distinct", {num} AS "numeric",
        {f'round(sum({e}), 4)' if num == 'true' else 'NULL'} AS sum, {f'round(sum({e}) / count({e}), 4)' if num == 'true' else 'NULL'} AS avg FROM orders"""
        for c, e, num in (("o_orderkey", "o_orderkey", "true"), ("o_custkey", "o_custkey", "true"), ("o_orderstatus", "o_orderstatus", "false"), ("o_orderpriority", "o_orderpriority", "false"), ("price", "round(o_totalprice, 2)", "true"))
    ),
    "column_ranges": " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) AS rows, count(*) FILTER (trim(coalesce(v, '')) <> '') AS non_empty, count(DISTINCT coalesce(v, '')) AS "distinct",
        {f'min(CAST(v AS DOUBLE)) AS min, max(CAST(v AS DOUBLE)) AS max, round(avg(CAST(v AS DOUBLE)), 4) AS avg' if num else 'CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max, CAST(NULL AS DOUBLE) AS avg'},
        array_to_string(list_sort(list_distinct(list(v) FILTER (trim(v) <> '')))[1:5], ', ') AS examples FROM (SELECT CAST({e} AS VARCHAR) AS v FROM orders)"""
        for c, e, num in (("o_orderkey", "o_orderkey", True), ("o_custkey", "o_custkey", True), ("o_orderstatus", "o_orderstatus", False),
                          ("o_orderpriority", "CASE WHEN o_orderkey % 5 = 0 THEN ' ' ELSE o_orderpriority END", False))
    ),
    "log_view": f"""WITH e AS (SELECT event_id, event_type, coalesce(CAST(user_id AS VARCHAR), '?') AS u, CASE {' '.join(f"WHEN regexp_matches(lower(coalesce(event_type, '')), '{p}') THEN '{lv}'" for lv, p in text.LEVELS.items())} ELSE 'default' END AS level
        FROM events ORDER BY event_id DESC LIMIT 1000)
        SELECT level, '[' || upper(level) || '] user ' || u || ' id=' || event_id || ' severity=' || coalesce(event_type, '') AS text FROM e WHERE u LIKE '1%'""",
    "score_percents": """SELECT p_partkey, CAST(floor(p_partkey % 1001 / 1000.0::DOUBLE * 100 + 0.5) AS BIGINT) AS percent,
        round(CASE WHEN p_partkey % 7 = 0 THEN 0.25 WHEN p_partkey % 160 - 10 > 1 THEN least((p_partkey % 160 - 10) / 100.0::DOUBLE, 1) ELSE greatest(p_partkey % 160 - 10, 0) END::DOUBLE, 4) AS share FROM part""",
    "byte_sizes": f"""WITH b AS (SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n FROM documents), c AS (SELECT *, n * n * n AS m FROM b) SELECT doc_id,
        {', '.join("CASE WHEN coalesce(" + v + ", 0) <= 0 THEN '0 B' WHEN " + v + " < 1024 THEN " + v + " || ' B' " + ' '.join(f"WHEN {v} < {1024 ** (k + 1)} THEN printf('%.1f {u}iB', {v} / {1024 ** k}.0::DOUBLE)" for k, u in enumerate('KMGTP', 1)) + ' END AS ' + name for v, name in (('n', 'size'), ('m', 'cube')))},
        least(n * 100 // 4096, 100) AS percent FROM c""",
    "top_values": """WITH c AS (SELECT 'o_orderstatus' AS "column", o_orderstatus AS value FROM orders UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders
        UNION ALL SELECT 'o_custkey', CAST(o_custkey AS VARCHAR) FROM orders), n AS (SELECT "column", value, count(*) AS n FROM c GROUP BY 1, 2)
        SELECT "column", value, n, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rank FROM n QUALIFY rank <= 8""",
    "pivot_summary": """SELECT p_brand, count(*) AS count, round(sum(p_size)::DOUBLE, 3) AS sum_p_size, round(sum(p_retailprice), 3) AS sum_p_retailprice
        FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100""",
    "quick_chart": "SELECT event_type AS x, round(sum(value), 3) AS value FROM events GROUP BY 1 ORDER BY 2 DESC LIMIT 20",
    "spec_chart_avg": "SELECT strftime(ts, '%Y-%m-%d') AS x, round(coalesce(sum(value), 0) / count(*), 3) AS value FROM events GROUP BY 1",
    "log_lines": """WITH l AS (SELECT *, CASE WHEN regexp_matches(event_type, 'fatal|panic|critical|crit') THEN 'fatal' WHEN regexp_matches(event_type, 'error|err|fail') THEN 'error'
        WHEN regexp_matches(event_type, 'warn') THEN 'warn' WHEN regexp_matches(event_type, 'debug|trace') THEN 'debug' WHEN regexp_matches(event_type, 'info|notice|ok|success|succeeded') THEN 'info' ELSE 'default' END AS level FROM events)
        SELECT level, concat_ws(' ', strftime(ts, '%Y-%m-%d %H:%M:%S'), '[' || upper(level) || ']', nullif(props, ''), 'status=' || coalesce(event_type, ''), 'user_id=' || coalesce(CAST(user_id AS VARCHAR), '')) AS text FROM l""",
    "canonical_names": f"""SELECT p_partkey, array_to_string({_tokens("('Müller & Söhne ' || p_name || ' GmbH')")}, ' ') AS name FROM part""",
    "house_numbers": """WITH n AS (SELECT c_custkey, upper(regexp_replace(c_name, '[^A-Za-z]', '', 'g')) AS w, CAST(c_custkey % 90 AS VARCHAR) || CASE WHEN c_custkey % 4 = 0 THEN 'B' ELSE '' END AS x,
        CAST(c_custkey % 45 AS VARCHAR) || CASE WHEN c_custkey % 4 = 0 THEN 'B' ELSE '' END AS y FROM customer)
        SELECT c_custkey, x AS number, CAST(CASE WHEN x = y THEN 0.3 ELSE 0.0 END AS DOUBLE) AS score FROM n""",
    "numeric_scores": """WITH v AS (SELECT p_partkey, CAST(p_partkey + 0.5 AS DOUBLE) AS a, CAST(p_partkey + p_partkey % 7 + 0.5 AS DOUBLE) AS b FROM part)
        SELECT p_partkey, round(CASE WHEN a = b THEN 1.0 ELSE greatest(0.0, 1 - abs(a - b) / greatest(abs(a), abs(b)) / 0.05) END, 4) AS score FROM v""",
    "ean_codes": """WITH v AS (SELECT p_partkey, lpad(CAST(p_partkey * 7919 AS VARCHAR), 13, '4') AS code FROM part)
        SELECT p_partkey, code, (10 - list_sum(list_transform(range(1, 13), lambda i: CAST(code[i] AS INTEGER) * CASE WHEN i % 2 = 0 THEN 3 ELSE 1 END)) % 10) % 10 = CAST(code[13] AS INTEGER) AS valid FROM v""",
    "match_token_set": f"""WITH {_NAMES}, k AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY j DESC, t) AS rk FROM pairs WHERE j >= 0.5)
        SELECT s AS source_key, t AS target_key, round(j, 6) AS score, CASE WHEN j >= 0.9 THEN 'auto' ELSE 'review' END AS status FROM k WHERE rk <= 3""",
    "match_grouped": f"""WITH {_NAMES}, g AS (SELECT s, t, (2 * j + 2 * least(CASE WHEN p = q THEN 1.0 ELSE greatest(0.0, 1 - abs(p - q) / greatest(abs(p), abs(q)) / 0.5) END,
        CASE WHEN list_sort(x) = list_sort(y) THEN 1.0 ELSE 0.0 END)) / 4 AS sc FROM pairs), k AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY sc DESC, t) AS rk FROM g WHERE sc >= 0.4)
        SELECT s AS source_key, t AS target_key, round(sc, 6) AS score, CASE WHEN sc >= 0.9 THEN 'auto' ELSE 'review' END AS status FROM k WHERE rk <= 3""",
    "match_stats": f"""WITH {_NAMES}, k AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY j DESC, t) AS rk FROM pairs WHERE j >= 0.5), m AS (SELECT * FROM k WHERE rk <= 3)
        SELECT (SELECT count(*) FROM a) AS sources, (SELECT count(*) FROM m WHERE j >= 0.9) AS auto, (SELECT count(*) FROM m WHERE j < 0.9) AS review,
        (SELECT count(*) FROM a WHERE s NOT IN (SELECT s FROM m)) AS unmatched""",
    "jaro_winkler": """WITH p AS (SELECT x.n_name AS a, y.n_name AS b, jaro_similarity(x.n_name, y.n_name) AS j FROM nation x, nation y)
        SELECT a, b, round(j + 0.1 * (CASE WHEN a[1] <> b[1] THEN 0 WHEN a[2] <> b[2] THEN 1 WHEN a[3] <> b[3] THEN 2 WHEN a[4] <> b[4] THEN 3 ELSE 4 END) * (1 - j), 6) AS score FROM p""",
}
