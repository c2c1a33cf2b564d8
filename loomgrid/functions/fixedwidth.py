"""Fixed-width lines as a splittable DataFrame: the column spans come from all lines, by one aggregation."""

from __future__ import annotations

from itertools import count, groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def field_spans(lines: DataFrame, column: str = "value") -> list[tuple[int, int]]:
    """(first position from 1, length) of the maximal runs of positions that some line fills.

    Each task keeps the distinct positions it has met, so the shuffle and the driver see no more rows than the widest line has
    positions. Blank and null lines fill nothing; no lines give no spans.
    """
    line = F.col(column)
    filled = F.filter(F.sequence(F.lit(1), F.length(line)), lambda i: F.substr(line, i, F.lit(1)).rlike(r"[^\s]"))
    used = sorted(r[0] for r in lines.where(F.length(line) > 0).select(F.explode(filled).alias("i")).distinct().collect())
    runs = [list(g) for _, g in groupby(used, key=lambda i, c=count(): i - next(c))]
    return [(r[0], len(r)) for r in runs]


def split_fields(lines: DataFrame, spans: list[tuple[int, int]], names: list[str] | None = None, column: str = "value") -> DataFrame:
    """One trimmed text column per span; blank lines go."""
    names = names or [f"col_{i + 1}" for i in range(len(spans))]
    if len(names) != len(spans):
        raise ValueError(f"{len(names)} names for {len(spans)} columns")
    cell = lambda a, n: F.trim(F.substr(F.col(column), F.lit(a), F.lit(n)))
    return lines.where(F.trim(column) != "").select(*[cell(a, n).alias(name) for (a, n), name in zip(spans, names)])
