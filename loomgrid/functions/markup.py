"""HTML tables and JSON cells inside columns, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clean_cell(c: Column) -> Column:
    """Line breaks kept, tags gone, common entities resolved."""
    c = F.regexp_replace(F.regexp_replace(c, r"(?i)<br\s*/?>", "\n"), "<[^>]+>", "")
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(sign))
    return F.trim(c)


def html_table_rows(df: DataFrame, html: str, keep: list[str]) -> DataFrame:
    """``keep`` columns plus table_index, row_index, cells array<string>, of all tables in a column of HTML."""
    inner = lambda c, tag: F.regexp_extract_all(c, F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>"), 1)
    t = df.select(*keep, F.posexplode(inner(F.col(html), "table")).alias("t", "body"))
    r = t.select(*keep, (F.col("t") + 1).alias("table_index"), F.posexplode(inner(F.col("body"), "tr")).alias("r", "row"))
    cells = F.transform(F.regexp_extract_all("row", F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), 1), clean_cell)
    return r.select(*keep, "table_index", (F.col("r") + 1).alias("row_index"), cells.alias("cells")).where(F.size("cells") > 0)


def json_number(c: Column, key: str) -> Column:
    """A number, or a text that is one, below a key of JSON text."""
    return F.get_json_object(c, f"$.{key}").try_cast("double")


def json_merge(a: Column, b: Column) -> Column:
    """Two flat JSON objects as one map; the right one wins."""
    m = lambda c: F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))
    left = F.map_filter(m(a), lambda k, _: ~F.array_contains(F.map_keys(m(b)), k))
    return F.map_concat(left, m(b))
