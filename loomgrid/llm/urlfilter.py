"""Temporal list join: every capture is judged by the list entries that were active when it was fetched.

Dated entries (list, pattern, listed_on, action, category) become validity intervals. An entry is what one list says of
one pattern in one category, and has its own intervals: other lists and categories neither end nor extend them. A removal
closes the entry of its own list, pattern and category, or with a null category all entries of its list on the pattern.
A pattern names a host and covers its subdomains. A capture is blocked if any entry is active; the most specific pattern
is reported, and of its entries all categories, and the one listed last.

The list is judged once per (pattern, day) that occurs, so a domain that covers a third of all captures costs as many
as-of lookups as it has days. Those answers, and those of a (host, day), come back to the rows in SALT copies, each to
its share of the rows, so that no task gets all rows of one domain or host.

Cases: an addition and a removal of one entry on one day: the removal wins; a removal without an addition has no effect;
an entry without pattern or day is ignored, one without list or category is an entry like others; a capture without host
or day matches nothing; repeated captures are all kept; an empty list blocks nothing. A dot at the end of a host or
pattern is ignored; addresses (IPv4, or IPv6 in brackets) match as a whole. Extra columns of captures are dropped unless
named in ``keep``; one named like a column of the result comes back as ``kept_<name>``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgrid.llm.common import table

HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/:?#]+)"
ADDRESS = r"^(\[.*\]|[0-9.]+)$"
SALT = 16  # copies of an answer on its way back to the rows it decides
RESULT = ("host", "fetched_on", "blocked", "pattern", "category", "categories", "valid_from")


def host_of(url: Column) -> Column:
    return F.nullif(F.rtrim(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(".")), F.lit(""))


def intervals(entries: DataFrame) -> DataFrame:
    """pattern, list, category, valid_from, valid_to (null: still open) of the additions."""
    own = F.col("list") if "list" in entries.columns else F.lit(None)
    e = entries.select(
        own.cast("string").alias("list"), F.nullif(F.rtrim(F.lower("pattern"), F.lit(".")), F.lit("")).alias("pattern"),
        F.col("listed_on"), F.coalesce(F.col("action") == "remove", F.lit(False)).alias("gone"), F.col("category"),
    ).where("pattern IS NOT NULL AND listed_on IS NOT NULL")
    adds, removals = e.where("NOT gone"), e.where("gone")
    known = adds.select("list", "pattern", "category").distinct()
    wide = removals.where("category IS NULL").select(F.col("list").alias("__l"), F.col("pattern").alias("__p"), "listed_on").distinct()
    all_of = known.join(wide, F.col("list").eqNullSafe(F.col("__l")) & (F.col("pattern") == F.col("__p"))).select("list", "pattern", "listed_on", F.lit(True).alias("gone"), "category")
    day = adds.unionByName(removals.where("category IS NOT NULL")).unionByName(all_of).groupBy("list", "pattern", "category", "listed_on").agg(F.max("gone").alias("gone"))
    w = Window.partitionBy("list", "pattern", "category").orderBy("listed_on")
    return day.select("pattern", "list", "category", F.col("listed_on").alias("valid_from"), F.lead("listed_on").over(w).alias("valid_to"), "gone").where("NOT gone").drop("gone")


def suffixes(host: Column) -> Column:
    """The host and its parents down to two labels, or the host alone if it has one or is an address."""
    parts = F.split(host, r"\.")
    return F.when(host.rlike(ADDRESS), F.array(host)).otherwise(
        F.transform(
            F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))),
            lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."),
        )
    )


def _copies(answers: DataFrame) -> DataFrame:
    return answers.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))


def _share(*cols: str) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(SALT)).cast("int").alias("__salt")


def temporal_list_join(captures: DataFrame, entries: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns plus RESULT."""
    inner = [f"__in_{i}" for i in range(len(keep))]
    c = captures.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(keep, inner)], host_of(F.col("url")).alias("host"), F.col("fetched_on"))
    asked = c.where("host IS NOT NULL AND fetched_on IS NOT NULL").select("host", "fetched_on").distinct()
    spread = asked.select("host", "fetched_on", F.explode(suffixes(F.col("host"))).alias("pattern"))
    active = (
        spread.select("pattern", "fetched_on").distinct()
        .join(intervals(entries), "pattern")
        .where("valid_from <= fetched_on AND (valid_to IS NULL OR fetched_on < valid_to)")
        .groupBy("pattern", "fetched_on")
        .agg(F.max(F.struct("valid_from", F.struct(F.isnotnull("category"), "category").alias("c"))).alias("m"), F.array_sort(F.collect_set("category")).alias("categories"))
    )
    hit = (
        spread.withColumn("__salt", _share("host"))
        .join(_copies(active), ["pattern", "fetched_on", "__salt"])
        .groupBy("host", "fetched_on")
        .agg(F.max(F.struct(F.length("pattern").alias("n"), "pattern", F.col("m.c.category").alias("category"), "categories", F.col("m.valid_from").alias("valid_from"))).alias("m"))
        .select("host", "fetched_on", "m.pattern", "m.category", "m.categories", "m.valid_from")
    )
    salted = c.withColumn("__salt", _share(*inner) if inner else F.lit(0))
    got = salted.join(_copies(hit), ["host", "fetched_on", "__salt"], "left").select(
        *inner, "host", "fetched_on", F.col("pattern").isNotNull().alias("blocked"), "pattern", "category", "categories", "valid_from"
    )
    return got.toDF(*[f"kept_{k}" if k in RESULT else k for k in keep], *RESULT)


def captures_of(pages: DataFrame) -> DataFrame:
    """The test tables carry no fetch time; a day of 2024 follows from the page id."""
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 37 % 366).cast("int")).alias("fetched_on"))


def entries_of(pages: DataFrame) -> DataFrame:
    """Two dated lists: one over the hosts that occur, with additions and removals on days that follow from a host's spelling,
    and one over parent domains."""
    h = pages.select(host_of(F.col("url")).alias("pattern")).where("pattern IS NOT NULL").distinct()
    start = (F.length("pattern") * 31 + F.ascii(F.substring("pattern", 3, 1)) * 7) % 150
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int"))
    steps = ((0, "add", "spam"), (60, "remove", "spam"), (120, "add", "malware"), (150, "add", "spam"), (170, "add", "adult"), (185, "remove", "malware"), (200, "remove", None))
    dated = h.select("pattern", F.explode(F.array(*[F.struct((start + d).alias("n"), F.lit(a).alias("action"), F.lit(cat).cast("string").alias("category")) for d, a, cat in steps])).alias("e"))
    own = dated.select(F.lit("hosts").alias("list"), "pattern", day(F.col("e.n")).alias("listed_on"), "e.action", "e.category")
    domain = h.select(F.element_at(suffixes(F.col("pattern")), -1).alias("pattern")).where("pattern LIKE '%.net'").distinct()
    said = lambda on, action, category: domain.select(F.lit("domains").alias("list"), "pattern", F.lit(on).cast("date").alias("listed_on"), F.lit(action).alias("action"), F.lit(category).cast("string").alias("category"))
    return own.unionByName(said("2024-03-01", "add", "network")).unionByName(said("2024-05-01", "remove", None))


def op7_temporal_list_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    got = temporal_list_join(captures_of(pages), entries_of(pages), ["page_id", "url"])
    return got.withColumn("categories", F.array_join("categories", ","))


OP7_SQL = r"""
WITH cap AS (SELECT page_id, url, nullif(rtrim(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/:?#]+)', 1)), '.'), '') AS host,
    DATE '2024-01-01' + CAST(page_id * 37 % 366 AS INTEGER) AS fetched_on FROM pages),
hosts AS (SELECT DISTINCT host AS pattern FROM cap WHERE host IS NOT NULL),
doms AS (SELECT DISTINCT array_to_string(string_split(pattern, '.')[-2:], '.') AS pattern FROM hosts),
adds AS (
  SELECT 'hosts' AS list, pattern, DATE '2024-01-01' + CAST((length(pattern) * 31 + ascii(substr(pattern, 3, 1)) * 7) % 150 + d AS INTEGER) AS valid_from, category
  FROM hosts, (VALUES (0, 'spam'), (120, 'malware'), (150, 'spam'), (170, 'adult')) e(d, category)
  UNION ALL SELECT 'domains', pattern, DATE '2024-03-01', 'network' FROM doms WHERE pattern LIKE '%.net'),
gone AS (
  SELECT 'hosts' AS list, pattern, DATE '2024-01-01' + CAST((length(pattern) * 31 + ascii(substr(pattern, 3, 1)) * 7) % 150 + d AS INTEGER) AS listed_on, category
  FROM hosts, (VALUES (60, 'spam'), (185, 'malware'), (200, NULL)) e(d, category)
  UNION ALL SELECT 'domains', pattern, DATE '2024-05-01', NULL FROM doms WHERE pattern LIKE '%.net'),
act AS (SELECT cap.page_id, a.* FROM cap JOIN adds a ON (host = pattern OR ends_with(host, '.' || pattern)) AND valid_from <= fetched_on
  WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.list = a.list AND g.pattern = a.pattern AND (g.category = a.category OR g.category IS NULL)
    AND g.listed_on >= a.valid_from AND g.listed_on <= cap.fetched_on)),
longest AS (SELECT page_id, max(length(pattern)) AS n FROM act GROUP BY page_id),
hit AS (SELECT act.page_id, any_value(pattern) AS pattern, max_by(category, strftime(valid_from, '%Y-%m-%d') || category) AS category,
    array_to_string(list_sort(list_distinct(list(category))), ',') AS categories, max(valid_from) AS valid_from
  FROM act JOIN longest ON act.page_id = longest.page_id AND length(pattern) = n GROUP BY act.page_id)
SELECT cap.page_id, url, host, fetched_on, pattern IS NOT NULL AS blocked, pattern, category, categories, valid_from
FROM cap LEFT JOIN hit ON cap.page_id = hit.page_id
"""
