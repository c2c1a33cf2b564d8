"""Fuzzy record linkage of two tables: token blocking, field scores, grouped vetoes, best targets per source.

Blocking is an equi-join on the tokens of a column's distinct values, once per pair of columns whatever the number of rules
on it, so it never compares all pairs; rows come in by their values afterwards. A token that fills a large part of one
side is split by AQE's skew join. Cheap scores are Column expressions; Jaro-Winkler runs, Arrow-batched,
only on blocked pairs.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.functions import text as X

BLOCKING = {"normalized", "similarity", "token_set", "address"}
METHODS = BLOCKING | {"exact", "exact_ci", "numeric", "ean"}


@dataclass(frozen=True)
class Rule:
    """One compared field. Rules with the same group name count as one field with their least score."""

    source: str
    target: str
    method: str
    weight: float = 1.0
    tolerance: float = 0.0
    group: str = ""


def prepare(df: DataFrame, side: str, rules: list[Rule]) -> DataFrame:
    """What a side's cells are compared by, computed once per distinct row and not once per pair."""
    out = df
    for i, r in enumerate(rules):
        c = F.col(f"{side}_{i}")
        if r.method in ("normalized", "token_set", "similarity"):
            out = out.withColumn(f"{side}k_{i}", X.canonical_tokens(c))
        elif r.method == "address":
            out = out.withColumn(f"{side}k_{i}", X.street_tokens(c)).withColumn(f"{side}n_{i}", X.house_number(c))
        elif r.method == "ean":
            out = out.withColumn(f"{side}v_{i}", X.ean_valid(c))
    return out


def field_score(i: int, r: Rule) -> Column:
    """Null where the two cells cannot be compared: a blank on a side, no number, no valid code."""
    a, b, ta, tb = (F.col(f"{x}_{i}") for x in ("s", "t", "sk", "tk"))
    blank = (F.trim(F.coalesce(a, F.lit(""))) == "") | (F.trim(F.coalesce(b, F.lit(""))) == "")
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    score = {
        "exact": lambda: one(a == b),
        "exact_ci": lambda: one(F.lower(a) == F.lower(b)),
        "normalized": lambda: one(ta == tb),
        "similarity": lambda: X.jaro_winkler(F.array_join(ta, " "), F.array_join(tb, " ")),
        "token_set": lambda: F.when((F.size(ta) > 0) & (F.size(tb) > 0), X.jaccard(ta, tb)),
        "address": lambda: X.street_score(ta, tb, F.col(f"sn_{i}"), F.col(f"tn_{i}")),
        "numeric": lambda: X.numeric_score(a, b, r.tolerance),
        "ean": lambda: F.when(F.col(f"sv_{i}") & F.col(f"tv_{i}"), one(a == b)),
    }[r.method]()
    return F.when(~blank, score)


def block_tokens(values: DataFrame, column: str) -> DataFrame:
    """(value, token): tokens of three or more bytes of a blockable column."""
    return values.select(column, F.explode(F.array_distinct(X.canonical_tokens(F.col(column)))).alias("token")).where(F.octet_length("token") >= 3)


def candidates(source: DataFrame, target: DataFrame, rules: list[Rule], max_pairs: int | None = 4_000_000) -> DataFrame:
    """Distinct (s, t) keys that share a token in a blockable field; without such a field, all pairs below a guard."""
    use = [r for r in rules if r.method in BLOCKING]
    if not use:
        n = source.count() * target.count()
        if max_pairs is not None and n > max_pairs:
            raise ValueError(f"{n} pairs without blocking; the limit is {max_pairs}")
        return source.select("s").crossJoin(target.select("t"))
    columns = {(r.source, r.target): rules.index(r) for r in reversed(use)}
    found = []
    for i in columns.values():  # one per pair of columns
        a, b = source.select("s", F.col(f"s_{i}").alias("__v")), target.select("t", F.col(f"t_{i}").alias("__w"))
        values = block_tokens(a.select("__v").distinct(), "__v").join(block_tokens(b.select("__w").distinct(), "__w"), "token").select("__v", "__w").distinct()
        found.append(a.join(values, "__v").join(b, "__w").select("s", "t"))
    out = reduce(DataFrame.unionAll, found)
    return out.distinct() if len(found) > 1 else out


def pair_score(rules: list[Rule]) -> Column:
    """Weighted mean over comparable fields; a group weighs the sum of its comparable members and scores their least."""
    groups: dict[str, list[int]] = {}
    for i, r in enumerate(rules):
        groups.setdefault(r.group or f"#{i}", []).append(i)
    num, den = [], []
    for members in groups.values():
        scores = [F.col(f"f_{i}") for i in members]
        least = F.least(*scores) if len(scores) > 1 else scores[0]
        weight = reduce(lambda a, b: a + b, [F.when(F.col(f"f_{i}").isNotNull(), rules[i].weight if rules[i].weight > 0 else 1.0).otherwise(0.0) for i in members])
        num.append(F.coalesce(least * weight, F.lit(0.0)))
        den.append(weight)
    total = reduce(lambda a, b: a + b, den)
    return F.when(total > 0, reduce(lambda a, b: a + b, num) / total)


def resolve_column(df: DataFrame, name: str) -> str:
    """A column by name, whatever its case."""
    found = next((c for c in df.columns if c.lower() == name.lower()), None)
    if found is None:
        raise ValueError(f"no column {name!r}; there are {', '.join(df.columns)}")
    return found


def match(
    source: DataFrame, target: DataFrame, source_key: str, target_key: str, rules: list[Rule],
    auto: float = 0.9, review: float = 0.6, max_candidates: int = 3, max_pairs: int | None = 4_000_000,
    max_comparisons: int | None = None, max_rows: int | None = None,
) -> DataFrame:
    """source_key, target_key, score, status: up to ``max_candidates`` targets of each source, best first (ties by target key).

    ``max_rows`` refuses larger tables, ``max_comparisons`` a blocking that leaves more pairs of distinct rows. Both read
    no further than their limit, and neither drops anything: a match over them is an error.
    """
    for side, df in (("source", source), ("target", target)):
        if max_rows is not None and df.limit(max_rows + 1).count() > max_rows:
            raise ValueError(f"the {side} has over {max_rows} rows")
    if bad := [r.method for r in rules if r.method not in METHODS]:
        raise ValueError(f"unknown methods {bad}")
    auto = max(auto, review)
    if max_pairs is not None and not any(r.method in BLOCKING for r in rules) and (n := source.count() * target.count()) > max_pairs:
        raise ValueError(f"{n} pairs without blocking; the limit is {max_pairs}")
    s = source.select(F.col(resolve_column(source, source_key)).cast("string").alias("s"), *[F.col(resolve_column(source, r.source)).cast("string").alias(f"s_{i}") for i, r in enumerate(rules)])
    t = target.select(F.col(resolve_column(target, target_key)).cast("string").alias("t"), *[F.col(resolve_column(target, r.target)).cast("string").alias(f"t_{i}") for i, r in enumerate(rules)])
    # Rows with equal cells are compared once: pairs are of distinct rows, and keys come back in after the ranking.
    s_keys, t_keys = s.withColumnRenamed("s", "source_key"), t.withColumnRenamed("t", "target_key")
    s_keys, t_keys = s_keys.withColumn("s", row_hash("s", rules)), t_keys.withColumn("t", row_hash("t", rules))
    a = s_keys.drop("source_key").dropDuplicates(["s"])
    b = t_keys.drop("target_key").dropDuplicates(["t"])
    blocked = candidates(a, b, rules, None)
    if max_comparisons is not None and blocked.limit(max_comparisons + 1).count() > max_comparisons:
        raise ValueError(f"blocking leaves over {max_comparisons} comparisons; narrow the rules or the tables")
    pairs = blocked.join(prepare(a, "s", rules), "s").join(prepare(b, "t", rules), "t")
    scored = pairs.select("s", "t", *[field_score(i, r).alias(f"f_{i}") for i, r in enumerate(rules)])
    kept = scored.select("s", "t", pair_score(rules).alias("score")).where(F.col("score") >= review)
    # pairs that more than max_candidates others of their source beat are out before the target keys come in; ties stay
    kept = kept.withColumn("place", F.rank().over(Window.partitionBy("s").orderBy(F.desc("score")))).where(F.col("place") <= max_candidates).drop("place")
    few = Window.partitionBy("t").orderBy("target_key")
    first_keys = t_keys.select("t", "target_key").withColumn("n", F.row_number().over(few)).where(F.col("n") <= max_candidates).drop("n")
    best = Window.partitionBy("s").orderBy(F.desc("score"), "target_key")
    ranked = kept.join(first_keys, "t").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= max_candidates)
    return s_keys.select("s", "source_key").join(ranked, "s").select("source_key", "target_key", "score", F.when(F.col("score") >= auto, "auto").otherwise("review").alias("status"))


def row_hash(side: str, rules: list[Rule]) -> Column:
    """The identity of a row's compared cells, in 16 bytes."""
    return F.unhex(F.substring(F.sha2(F.to_json(F.struct(*[F.col(f"{side}_{i}") for i in range(len(rules))]), {"ignoreNullFields": "false"}), 256), 1, 32))


def match_stats(source: DataFrame, source_key: str, matches: DataFrame) -> DataFrame:
    """sources, auto and review pairs, and sources without a match."""
    total = source.select(F.col(source_key).cast("string").alias("source_key"))
    lost = total.join(matches.select("source_key"), "source_key", "left_anti").agg(F.count("*").alias("unmatched"))
    pairs = matches.agg(F.count_if(F.col("status") == "auto").alias("auto"), F.count_if(F.col("status") == "review").alias("review"))
    return total.agg(F.count("*").alias("sources")).crossJoin(pairs).crossJoin(lost)  # three single rows


def crosswalk(matches: DataFrame, source_labels: DataFrame, target_labels: DataFrame) -> DataFrame:
    """The stored form of a match: labels (key, label) joined in, with the time of the run."""
    s = source_labels.select(F.col("key").alias("source_key"), F.col("label").alias("source_label"))
    t = target_labels.select(F.col("key").alias("target_key"), F.col("label").alias("target_label"))
    label = lambda c, k: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.col(k)).alias(c)
    return matches.join(s, "source_key", "left").join(t, "target_key", "left").select(
        "source_key", label("source_label", "source_key"), "target_key", label("target_label", "target_key"), "score", "status",
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("matched_at"),
    )


def suggest_pairs(source: list[str], target: list[str], least: float = 0.6, most: int = 8) -> list[tuple[str, str, float]]:
    """Column names of two tables that look alike, each used once, best first; id columns are left out."""
    flat = lambda c: c.lower().replace("_", "").replace(" ", "")
    scored = sorted(((X.winkler(flat(a), flat(b)), a, b) for a in source for b in target if "id" not in (a.lower(), b.lower())), key=lambda x: (-x[0], x[1], x[2]))
    out: list[tuple[str, str, float]] = []
    for score, a, b in scored:
        if score >= least and len(out) < most and a not in [x[0] for x in out] and b not in [x[1] for x in out]:
            out.append((a, b, score))
    return out
