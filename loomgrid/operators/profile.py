"""Column profiles, pivot summaries, chart aggregates and log views: one pass over long-form cells, not a job per column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.functions.text import log_level

NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def number(c: Column) -> Column:
    """A finite number, or null."""
    v = F.when(c.rlike(NUMBER), F.trim(c).try_cast("double"))
    return F.when(F.abs(v) < float("inf"), v)


def cells(df: DataFrame) -> DataFrame:
    """(column, position, value): every cell as text."""
    pairs = ", ".join(f"'{c}', {i}, CAST(`{c}` AS STRING)" for i, c in enumerate(df.columns))
    return df.selectExpr(f"stack({len(df.columns)}, {pairs}) AS (column, position, value)")


def column_profile(df: DataFrame) -> DataFrame:
    """Per column: rows, blanks (null or empty), distinct other values, whether all are numbers, their sum and average.

    The sum is exact where 18 decimals and 19 digits before them hold every value, and one of doubles otherwise.
    """
    c = cells(df).withColumn("v", F.nullif("value", F.lit("")))
    # counted by value first: a column with one hot value costs one row per task
    by_value = c.groupBy("column", "position", "v").agg(F.count("*").alias("n"))
    num = number(F.col("v"))
    exact = F.trim("v").try_cast("decimal(37,18)")
    exact = F.when(exact.cast("double") == num, exact)
    out = by_value.withColumn("__x", exact).groupBy("column", "position").agg(
        F.sum("n").alias("rows"), F.sum(F.when(F.col("v").isNull(), F.col("n")).otherwise(0)).alias("blanks"), F.count("v").alias("distinct"),
        (F.count("v") == F.count(num)).alias("all_numbers"), (F.count("__x") == F.count(num)).alias("fits"),
        # whole and fractional parts apart, so that no product needs more than 38 digits
        (F.expr("try_sum(CAST(__x AS DECIMAL(19, 0)) * CAST(n AS DECIMAL(18, 0)))").cast("double")
         + F.expr("try_sum(CAST(__x - CAST(__x AS DECIMAL(19, 0)) AS DECIMAL(19, 18)) * CAST(n AS DECIMAL(18, 0)))").cast("double")).alias("x"),
        F.sum(num * F.col("n")).alias("d"),
    )
    numeric = F.col("all_numbers") & (F.col("distinct") > 0)
    total = F.when(F.col("fits") & F.col("x").isNotNull(), F.col("x")).otherwise(F.col("d"))
    return out.select(
        "column", "rows", "blanks", "distinct", numeric.alias("numeric"),
        F.when(numeric, total).alias("sum"), F.when(numeric, total / (F.col("rows") - F.col("blanks"))).alias("avg"),
    )


def column_ranges(df: DataFrame, examples: int = 5) -> DataFrame:
    """Per column: rows, non_empty, distinct texts (a blank is one, null and empty alike), min, max and avg of its numbers, examples.

    A cell of white space only is blank. The examples are the first non-blank texts in order, since rows have none.
    """
    by_value = cells(df).withColumn("v", F.coalesce("value", F.lit(""))).groupBy("column", "position", "v").agg(F.count("*").alias("n"))
    there = F.trim("v") != ""
    num = F.when(there, number(F.col("v")))
    out = by_value.groupBy("column", "position").agg(
        F.sum("n").alias("rows"), F.sum(F.when(there, F.col("n")).otherwise(0)).alias("non_empty"), F.count("*").alias("distinct"),
        F.min(num).alias("min"), F.max(num).alias("max"), (F.sum(num * F.col("n")) / F.sum(F.when(num.isNotNull(), F.col("n")))).alias("avg"),
    )
    w = Window.partitionBy("column").orderBy("v")  # pruned per task before the shuffle
    few = by_value.where(there).withColumn("k", F.row_number().over(w)).where(F.col("k") <= examples)
    few = few.groupBy("column").agg(F.array_sort(F.collect_list("v")).alias("examples"))
    return out.join(few, "column", "left").select("column", "rows", "non_empty", "distinct", "min", "max", "avg", F.coalesce("examples", F.array().cast("array<string>")).alias("examples"))


def top_values(df: DataFrame, k: int = 8) -> DataFrame:
    """The k most frequent non-blank values of each column; ties by value."""
    c = cells(df).where(F.trim("value") != "").groupBy("column", "value").agg(F.count("*").alias("n"))
    w = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    return c.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def numeric_ratio(df: DataFrame) -> DataFrame:
    """Per column: the share of non-blank cells that are numbers."""
    c = cells(df).where(F.trim("value") != "")
    return c.groupBy("column", "position").agg((F.count(number(F.col("value"))) / F.count("*")).alias("ratio"))


def text_and_number_columns(df: DataFrame, text_below: float = 0.5, number_from: float = 0.6) -> tuple[str | None, list[str]]:
    rows = {r["column"]: r["ratio"] for r in numeric_ratio(df).collect()}
    text = next((c for c in df.columns if rows.get(c, 0.0) < text_below), None)
    return text, [c for c in df.columns if rows.get(c, 0.0) >= number_from]


def pivot_summary(df: DataFrame, text: str, numbers: list[str], limit: int = 100) -> DataFrame:
    """Count and sums by the text column; blanks as (blank)."""
    key = F.coalesce(F.nullif(F.trim(F.col(text).cast("string")), F.lit("")), F.lit("(blank)"))
    sums = [F.round(F.sum(number(F.col(n).cast("string"))), 3).alias(f"sum_{n}") for n in numbers]
    return df.groupBy(key.alias(text)).agg(F.count("*").alias("count"), *sums).orderBy(F.desc("count"), text).limit(limit)


def chart(df: DataFrame, x: str, y: str | None, agg: str = "sum", by_time: bool = False, limit: int = 20) -> DataFrame:
    """x, value: count, sum or average of y; an average divides by all rows of x. Bars are the largest, lines are in time order."""
    if agg not in ("count", "sum", "avg") or agg != "count" and y is None:
        raise ValueError(f"no chart aggregate: {agg} of {y}")
    key = F.coalesce(F.nullif(F.trim(F.col(x).cast("string")), F.lit("")), F.lit("(empty)"))
    total = F.coalesce(F.sum(number(F.col(y).cast("string"))), F.lit(0.0)) if y else None
    value = {"count": F.count("*").cast("double"), "sum": total, "avg": None if total is None else total / F.count("*")}[agg]
    out = df.groupBy(key.alias("x")).agg(F.round(value, 3).alias("value"))
    return out.orderBy("x") if by_time else out.orderBy(F.desc("value"), "x").limit(limit)


def log_lines(df: DataFrame, time: str | None, level: str | None, message: str | None) -> DataFrame:
    """level, text: one line per row, ``time [LEVEL] message other=value ...``."""
    rest = [c for c in df.columns if c not in (time, message)]
    parts = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in rest]
    source = F.col(level).cast("string") if level else F.concat_ws(" ", *[F.col(c).cast("string") for c in df.columns])
    lv = log_level(source)
    lead = [F.nullif(F.col(time).cast("string"), F.lit(""))] if time else []
    msg = [F.nullif(F.col(message).cast("string"), F.lit(""))] if message else []
    return df.select(lv.alias("level"), F.concat_ws(" ", *lead, F.concat(F.lit("["), F.upper(lv), F.lit("]")), *msg, *parts).alias("text"))


def log_view(df: DataFrame, order: str, text: str = "", last: int = 1000) -> DataFrame:
    """level, text: of the ``last`` rows by ``order``, those whose line holds ``text``, whatever the case. Roles go by column names."""
    lines = df.orderBy(F.desc(order)).limit(last)
    time, level, message = log_roles(df.columns)
    return log_lines(lines, time, level, message).where(F.contains(F.lower("text"), F.lit(text.lower())))


def log_roles(columns: list[str]) -> tuple[str | None, str | None, str | None]:
    """Time, level and message columns by their names; each name has one role."""
    import re

    roles: list[str | None] = [None, None, None]
    patterns = ("time|date|ts|timestamp|created|updated", "level|severity|status|priority", "msg|message|log|event|error|detail|text")
    for c in columns:
        k = next((i for i, p in enumerate(patterns) if roles[i] is None and re.search(p, c, re.I)), None)
        if k is not None:
            roles[k] = c
    return roles[0], roles[1], roles[2]
