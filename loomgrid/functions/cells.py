"""Kinds of text cells and typed projection: everything is read as text, then all columns are typed in one pass."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The grammar of typed cells. An exponent needs a fraction or a first digit other than zero.
INT = r"^-?(0|[1-9][0-9]*)$"
FLOAT = r"^-?((0|[1-9][0-9]*)\.[0-9]+([eE][+-]?[0-9]+)?|[1-9][0-9]*[eE][+-]?[0-9]+)$"
DATETIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})?$"
KINDS = ("blank", "bool", "datetime", "date", "time", "int", "float", "text")
SPARK_TYPE = {"int": "bigint", "float": "double", "bool": "boolean", "date": "date", "datetime": "timestamp", "time": "string", "text": "string", "blank": "string"}


def cell_kind(c: Column) -> Column:
    """The first kind in KINDS order whose rule the trimmed cell meets."""
    s = F.trim(c)
    return (
        F.when(c.isNull() | (s == ""), "blank")
        .when(F.lower(s).isin("true", "false"), "bool")
        .when(s.rlike(DATETIME) & F.try_to_timestamp(s).isNotNull(), "datetime")
        .when(s.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & s.try_cast("date").isNotNull(), "date")
        .when(s.rlike(r"^([01][0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9](\.[0-9]+)?)?$"), "time")
        .when(s.rlike(INT) & s.try_cast("bigint").isNotNull(), "int")
        .when(s.rlike(FLOAT) & (F.abs(s.try_cast("double")) < float("inf")), "float")
        .otherwise("text")
    )


def column_kinds(df: DataFrame) -> dict[str, str]:
    """The kind of every column over all rows, by one aggregation: blanks do not count, int and float make float, other mixes text."""
    sets = df.agg(*[F.collect_set(cell_kind(F.col(f"`{c}`").cast("string"))).alias(f"k{i}") for i, c in enumerate(df.columns)]).first()
    return {c: merge_kinds(set(sets[i])) for i, c in enumerate(df.columns)}


def merge_kinds(kinds: set[str]) -> str:
    real = kinds - {"blank"}
    if real == {"int", "float"}:
        return "float"
    return real.pop() if len(real) == 1 else "text"


def typed(df: DataFrame, kinds: dict[str, str] | None = None) -> DataFrame:
    """Casts text columns to their kinds; cells that do not parse become null."""
    kinds = kinds or column_kinds(df)
    return df.select(*[_cast(F.col(f"`{c}`"), kinds[c]).alias(c) for c in df.columns])


def _cast(c: Column, kind: str) -> Column:
    if kind in ("text", "blank", "time"):
        return F.when(F.trim(c) != "", c)
    return F.trim(c).try_cast(SPARK_TYPE[kind])


def rejected(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Rows with a non-blank cell that its column's kind cannot hold, and the names of those columns."""
    bad = F.array_compact(F.array(*[F.when((F.trim(F.col(f"`{c}`")) != "") & _cast(F.col(f"`{c}`"), k).isNull(), F.lit(c)) for c, k in kinds.items()]))
    return df.withColumn("_errors", bad).where(F.size("_errors") > 0)


def column_name(raw: str, position: int) -> str:
    """An identifier from a header cell."""
    return re.sub(r"[^A-Za-z0-9_]", "_", raw or "").strip("_") or f"col_{position}"


def unique_names(raw: list[str]) -> list[str]:
    out: list[str] = []
    for i, name in enumerate(raw, 1):
        base = name = column_name(name, i)
        n = 2
        while name.lower() in {x.lower() for x in out}:
            name, n = f"{base}_{n}", n + 1
        out.append(name)
    return out


def looks_like_header(rows: list[list[str]]) -> bool:
    return len(rows) < 2 or all(re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", (c or "").strip()) for c in rows[0])
