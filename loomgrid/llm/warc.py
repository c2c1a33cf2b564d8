"""Merkle fixity audit of WARC files held in two replicas, in DataFrame functions only.

Records belong to files, and to ever smaller ranges inside a file, by their ids, never by their position: the ranges of
ids that share a parent are fixed, so a record that one replica lacks leaves a gap in its own range and moves nothing
else. A record's leaf is the SHA-256 of its bytes; every inner node is the SHA-256 of its level's mark and of its children
in offset order, each with its length and hash, so a node binds the extent and order of its range of offsets. The audit
compares the roots of each file and joins only the children of nodes that differ, level by level, down to the records of
single ids; there equal records cancel, and what is left over of an id is reported: changed records in pairs, a record
that one replica lacks with a null hash.

Records of one id are split by the first 16 bits of their hash before they are listed, and equal records are one row with
a count, so an id that holds a third of all records is dealt over many tasks, at every step.

Cases: a null URL or body counts as empty; null ids share a file of their own (-1); records of one id stay separate,
ordered by their hash; equal records are reported one by one if their number differs; offsets are those of the expected
replica, or of the found one for records that only it has; an empty table has no files. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgrid.llm.common import drop, null_safe, spill, table

FANOUT = 16
RECORDS_PER_FILE = 1024  # ids of a file
SPLIT = 4  # hex digits of a record's hash that deal out the records of one id


def record_text(record_id: Column, url: Column, body: Column) -> Column:
    """One WARC/1.0 resource record."""
    body = F.coalesce(body, F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(record_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def leaves(pages: DataFrame, records_per_file: int = RECORDS_PER_FILE) -> DataFrame:
    """file_id, page_id, part, hash, length, n: the distinct records of each file, n times each."""
    return (
        pages.select("page_id", record_text(F.col("page_id"), F.col("url"), F.col("html")).cast("binary").alias("__r"))
        .select(
            F.coalesce(F.floor(F.col("page_id") / F.lit(records_per_file)), F.lit(-1)).cast("long").alias("file_id"),
            F.col("page_id").cast("long").alias("page_id"),
            F.sha2("__r", 256).alias("hash"),
            F.octet_length("__r").cast("long").alias("length"),
        )
        .groupBy("file_id", "page_id", F.substring("hash", 1, SPLIT).alias("part"), "hash", "length")
        .agg(F.count("*").alias("n"))
    )


def node(level: int, order: str, *more: str) -> Column:
    """The hash of a node of ``level`` over its children in ``order``, each with its length and hash."""
    fields = list(dict.fromkeys((order, "length", "hash", *more)))
    listed = F.array_sort(F.collect_list(F.struct(*fields)))
    text = F.transform(listed, lambda c: F.concat_ws(":", *[F.coalesce(c[x].cast("string"), F.lit("-")) for x in fields]))
    return F.sha2(F.concat(F.lit(f"{level}|"), F.array_join(text, "|")), 256)


def ids_of(leaf: DataFrame) -> DataFrame:
    """file_id, page_id, length, hash: the node of each id, over its parts."""
    return parts_of(leaf).groupBy("file_id", "page_id").agg(node(2, "part").alias("hash"), F.sum("length").alias("length"))


def parts_of(leaf: DataFrame) -> DataFrame:
    return leaf.groupBy("file_id", "page_id", "part").agg(node(1, "hash", "n").alias("__h"), F.sum(F.col("length") * F.col("n")).alias("length")).withColumnRenamed("__h", "hash")


def ranges(ids: DataFrame, span: int, level: int, fanout: int) -> DataFrame:
    """file_id, idx, length, hash: nodes over ``span`` ids each, whose children cover ``span / fanout`` ids."""
    lower = ids.select("file_id", F.col("page_id").alias("idx"), "length", "hash") if span == fanout else ranges(ids, span // fanout, level - 1, fanout)
    up = F.floor(F.col("idx") / F.lit(fanout)).cast("long")
    return lower.groupBy("file_id", up.alias("__up")).agg(node(level, "idx").alias("hash"), F.sum("length").alias("length")).withColumnRenamed("__up", "idx")


def roots(ids: DataFrame, depth: int, fanout: int) -> DataFrame:
    top = ranges(ids, fanout**depth, 2 + depth, fanout)
    return top.groupBy("file_id").agg(node(3 + depth, "idx").alias("hash"), F.sum("length").alias("length"))


def differing(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of the nodes that are not equal in both replicas."""
    pair = null_safe(a.select(*keys, F.col("hash").alias("__a")), b.select(*keys, F.col("hash").alias("__b")), keys, "full_outer")
    return pair.where(~F.col("__a").eqNullSafe(F.col("__b"))).select(*keys)


def below(ids: DataFrame, bad: DataFrame, span: int) -> DataFrame:
    """The ids in the ranges ``bad`` of ``span`` ids each."""
    return null_safe(ids.withColumn("idx", F.floor(F.col("page_id") / F.lit(span)).cast("long")), bad, ["file_id", "idx"], "left_semi").drop("idx")


def starts(rows: DataFrame, group: list[str], order: str, size: Column, name: str) -> DataFrame:
    """``rows`` plus ``name``, the sum of ``size`` over the rows of their group before them."""
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.coalesce(F.sum(size).over(w), F.lit(0)).cast("long"))


def laid_out(leaf: DataFrame, ids: DataFrame, bad: DataFrame) -> DataFrame:
    """The records of the ids ``bad`` with their ``offset`` in the file: that of the id, of the part in it, and of the record in that.

    Each window holds the ids of one file, the parts of one id, or the records of one part.
    """
    key = ["file_id", "page_id"]
    in_file = starts(ids.join(bad.select("file_id").distinct(), "file_id", "left_semi"), ["file_id"], "page_id", F.col("length"), "__id")
    rows = null_safe(leaf, bad, key, "left_semi")
    part = rows.groupBy(*key, "part").agg(F.sum(F.col("length") * F.col("n")).alias("__size"))
    part = null_safe(starts(part, key, "part", F.col("__size"), "__part"), null_safe(in_file, bad, key, "left_semi").select(*key, "__id"), key, "inner")
    rows = starts(rows, [*key, "part"], "hash", F.col("length") * F.col("n"), "__own")
    rows = null_safe(rows, part.select(*key, "part", "__id", "__part"), [*key, "part"], "inner")
    return rows.select(*key, "part", "hash", "length", "n", (F.col("__id") + F.col("__part") + F.col("__own")).alias("offset"))


def left_over(mine: DataFrame, other: DataFrame, side: str) -> DataFrame:
    """The records of ``mine`` without an equal one in ``other``, singly, numbered by ``k`` within their id."""
    key = ["file_id", "page_id"]
    pair = null_safe(mine, other.select(*key, "part", "hash", F.col("n").alias("__m")), [*key, "part", "hash"], "left")
    extra = pair.withColumn("__m", F.coalesce("__m", F.lit(0))).where("n > __m").select(*key, "part", "hash", "length", "offset", "n", "__m")
    part = extra.groupBy(*key, "part").agg(F.sum(F.col("n") - F.col("__m")).alias("__k"))
    part = starts(part, key, "part", F.col("__k"), "__before").drop("__k")
    rows = starts(extra, [*key, "part"], "hash", F.col("n") - F.col("__m"), "__in_part")
    rows = null_safe(rows, part, [*key, "part"], "inner").withColumn("__j", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("__m") - 1)))
    return rows.select(
        *key, (F.col("__before") + F.col("__in_part") + F.col("__j")).alias("k"), F.col("hash").alias(f"{side}_hash"),
        F.col("length").alias(f"__{side}_length"), (F.col("offset") + (F.col("__m") + F.col("__j")) * F.col("length")).alias(f"__{side}_offset"),
    )


def audit(expected: DataFrame, found: DataFrame, fanout: int = FANOUT, records_per_file: int = RECORDS_PER_FILE) -> DataFrame:
    """file_id, page_id, offset, length, expected_hash, found_hash of the records that differ between two replicas' ``leaves``.

    Children are read only below nodes that differ. A record that one replica lacks is one row with a null hash there.
    """
    a, b = spill(expected, "replica-a"), spill(found, "replica-b")
    ia, ib = spill(ids_of(a), "ids-a"), spill(ids_of(b), "ids-b")
    depth = 1
    while fanout ** (depth + 1) < records_per_file:
        depth += 1
    suspects = [spill(differing(roots(ia, depth, fanout), roots(ib, depth, fanout), ["file_id"]), "bad-files")]
    for d in range(depth, 0, -1):
        span = fanout**d
        wider = span * fanout
        ia_, ib_ = ((x.join(suspects[-1], "file_id", "left_semi") if d == depth else below(x, suspects[-1], wider)) for x in (ia, ib))
        suspects.append(spill(differing(ranges(ia_, span, 2 + d, fanout), ranges(ib_, span, 2 + d, fanout), ["file_id", "idx"]), "bad-ranges"))
    bad = spill(differing(below(ia, suspects[-1], fanout), below(ib, suspects[-1], fanout), ["file_id", "page_id"]), "bad-ids")
    ra, rb = spill(laid_out(a, ia, bad), "bad-a"), spill(laid_out(b, ib, bad), "bad-b")
    pair = null_safe(left_over(ra, rb, "expected"), left_over(rb, ra, "found"), ["file_id", "page_id", "k"], "full_outer")
    out = spill(
        pair.select(
            "file_id", "page_id", F.coalesce("__expected_offset", "__found_offset").alias("offset"), F.coalesce("__expected_length", "__found_length").alias("length"),
            "expected_hash", "found_hash",
        ), "audit",
    )
    drop(a, b, ia, ib, bad, ra, rb, *suspects)
    return out


def damaged(pages: DataFrame) -> DataFrame:
    """The second replica of the registered query: one byte overwritten in some records, the body zeroed in others, some
    records missing in the middle of their files and some stored twice under ids that the first replica lacks."""
    html = F.coalesce("html", F.lit(""))
    kept = pages.where("page_id IS NULL OR page_id % 211 <> 11").select(
        "page_id", "url",
        F.when((F.col("page_id") % 97 == 5) & (html != ""), F.concat(F.lit("#"), F.expr("substr(coalesce(html, ''), 2)")))
        .when(F.col("page_id") % 389 == 7, F.repeat(F.lit("0"), F.length(html)))
        .otherwise(F.col("html")).alias("html"),
    )
    again = pages.where("page_id % 503 = 17").select((-F.col("page_id") - 1).alias("page_id"), "url", "html")
    return kept.unionByName(again)


def op10_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return audit(leaves(pages), leaves(damaged(pages)))


OP10_SQL = """
WITH crlf AS (SELECT chr(13) || chr(10) AS nl),
two AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS a,
    CASE WHEN page_id % 97 = 5 AND coalesce(html, '') <> '' THEN '#' || substr(html, 2)
         WHEN page_id % 389 = 7 THEN repeat('0', length(coalesce(html, ''))) ELSE coalesce(html, '') END AS b,
    page_id % 211 <> 11 AS in_b
  FROM pages),
body AS (
  SELECT 'a' AS replica, page_id, url, a AS html FROM two
  UNION ALL SELECT 'b', page_id, url, b FROM two WHERE in_b
  UNION ALL SELECT 'b', -page_id - 1, url, a FROM two WHERE page_id % 503 = 17),
rec AS (
  SELECT replica, page_id, CAST(floor(page_id / 1024) AS BIGINT) AS file_id,
    'WARC/1.0' || nl || 'WARC-Type: resource' || nl || 'WARC-Record-ID: <urn:page:' || page_id || '>' || nl || 'WARC-Target-URI: ' || url
      || nl || 'Content-Type: text/html' || nl || 'Content-Length: ' || strlen(html) || nl || nl || html || nl || nl AS r
  FROM body, crlf),
laid AS (
  SELECT replica, file_id, page_id, CAST(sum(strlen(r)) OVER w - strlen(r) AS BIGINT) AS "offset", CAST(strlen(r) AS BIGINT) AS length, sha256(r) AS hash
  FROM rec WINDOW w AS (PARTITION BY replica, file_id ORDER BY page_id))
SELECT coalesce(x.file_id, y.file_id) AS file_id, coalesce(x.page_id, y.page_id) AS page_id, coalesce(x."offset", y."offset") AS "offset",
  coalesce(x.length, y.length) AS length, x.hash AS expected_hash, y.hash AS found_hash
FROM (SELECT * FROM laid WHERE replica = 'a') x FULL JOIN (SELECT * FROM laid WHERE replica = 'b') y ON x.file_id = y.file_id AND x.page_id = y.page_id
WHERE x.hash IS DISTINCT FROM y.hash
"""
