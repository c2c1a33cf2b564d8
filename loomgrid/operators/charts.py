"""Choice of chart columns and checks of chart specifications."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.operators.profile import cells, chart, number

DATE = r"^[0-9]{4}(-[0-9]{2}(-[0-9]{2}([T ][0-9:.]+(Z|[+-][0-9:]+)?)?)?)?$"
ID_LIKE = re.compile(r"(^|_)(id|key|code|uuid|nr|no)$", re.I)
TIME_LIKE = re.compile(r"time|date|day|month|year|ts|created|updated", re.I)


def roles(df: DataFrame, date_from: float = 0.6, number_from: float = 0.9) -> dict[str, str]:
    """time, measure or dimension of each column, from shares of its non-blank cells and its name."""
    c = cells(df).where(F.trim("value") != "")
    share = c.groupBy("column").agg((F.count_if(F.trim("value").rlike(DATE)) / F.count("*")).alias("d"), (F.count(number(F.col("value"))) / F.count("*")).alias("n"))
    got = {r["column"]: (r["d"], r["n"]) for r in share.collect()}
    out = {}
    for col in df.columns:
        d, n = got.get(col, (0.0, 0.0))
        if d >= date_from and TIME_LIKE.search(col):
            out[col] = "time"
        else:
            out[col] = "measure" if n >= number_from and not ID_LIKE.search(col) else "dimension"
    return out


def defaults(found: dict[str, str]) -> tuple[str | None, str | None]:
    """x and y: a time column before a dimension, the first measure (none: counts)."""
    first = lambda kind: next((c for c, k in found.items() if k == kind), None)
    return first("time") or first("dimension"), first("measure")


def quick(df: DataFrame) -> DataFrame:
    found = roles(df)
    x, y = defaults(found)
    if x is None:
        raise ValueError("no column to chart by")
    return chart(df, x, y, "sum" if y else "count", by_time=found[x] == "time")


def checked_spec(spec: dict, columns: list[str]) -> dict:
    """A chart specification with known kind, aggregate and columns; anything else is an error."""
    low = {c.lower(): c for c in columns}
    kind, agg = spec.get("type", "bar"), spec.get("aggregate", "count")
    x, y = low.get(str(spec.get("x", "")).lower()), low.get(str(spec.get("y") or "").lower())
    if kind not in ("bar", "line", "area") or agg not in ("count", "sum", "avg") or x is None or agg != "count" and y is None:
        raise ValueError(f"no chart can be made of {spec}")
    return {"type": kind, "aggregate": agg, "x": x, "y": y, "title": str(spec.get("title", ""))[:120]}


def from_spec(df: DataFrame, spec: dict) -> DataFrame:
    s = checked_spec(spec, df.columns)
    return chart(df, s["x"], s["y"], s["aggregate"], by_time=s["type"] in ("line", "area"))


def result_summary(df: DataFrame, rows: int = 20) -> dict:
    """What a prompt is told of a result: some rows and the profile."""
    from loomgrid.operators.profile import column_profile, top_values

    return {
        "columns": df.columns, "rows": [r.asDict() for r in df.limit(rows).collect()], "profile": [r.asDict() for r in column_profile(df).collect()],
        "top": [r.asDict() for r in top_values(df).collect()],
    }
