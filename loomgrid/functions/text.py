"""Text normalisation and comparison as Column expressions; only Jaro-Winkler needs Python (an Arrow-batched UDF)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters with marks and the base letters they compare as.
MARKED = "äöüÄÖÜßàáâãåèéêëìíîïòóôõùúûñçýÀÁÂÃÅÈÉÊËÌÍÎÏÒÓÔÕÙÚÛÑÇÝ"
PLAIN = "aouAOUsaaaaaeeeeiiiioooouuuncyAAAAAEEEEIIIIOOOOUUUNCY"
# Company legal forms that names are compared without.
LEGAL_FORMS = (
    "GMBH MBH GMBHCOKG GGMBH AG KG KGAA OHG GBR EK EG UG EV STIFTUNG CO COKG INC LLC LLP LTD LTDA CORP SA SAS SARL SRL SPA SL BV NV PLC OY AB AS APS"
).split()


def fold_marks(c: Column) -> Column:
    return F.translate(c, MARKED, PLAIN)


def words(c: Column) -> Column:
    """Runs of letters and decimal digits."""
    return F.filter(F.split(F.regexp_replace(c, r"[^\p{L}\p{Nd}]", " "), " +"), lambda w: w != "")


def canonical_tokens(c: Column) -> Column:
    upper = F.upper(F.array_join(words(fold_marks(c)), " "))
    for pair, one in (("AE", "A"), ("OE", "O"), ("UE", "U")):
        upper = F.replace(upper, F.lit(pair), F.lit(one))
    tokens = F.filter(F.split(upper, " "), lambda w: w != "")
    kept = F.filter(tokens, lambda w: ~w.isin(LEGAL_FORMS))
    return F.when(F.size(kept) > 0, kept).otherwise(tokens)


def canonical_name(c: Column) -> Column:
    return F.array_join(canonical_tokens(c), " ")


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def house_number(c: Column) -> Column:
    """The last word if it is an integer with at most one letter behind it, upper-cased; else empty."""
    last = F.element_at(words(fold_marks(c)), -1)
    return F.when(F.size(words(fold_marks(c))) == 0, F.lit("")).when(last.rlike("^[0-9]{1,18}[A-Za-z]?$"), F.upper(last)).otherwise(F.lit(""))


def street_tokens(c: Column) -> Column:
    w = words(fold_marks(c))
    street = F.when(house_number(c) != "", F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0)))).otherwise(w)
    full = F.transform(street, lambda x: F.regexp_replace(F.upper(x), "STR$", "STRASSE"))
    return canonical_tokens(F.array_join(full, " "))


def street_score(sa: Column, sb: Column, na: Column, nb: Column) -> Column:
    """Of street tokens and house numbers: 70 % street and 30 % number, or the street alone if neither side has a number."""
    street = F.when((F.size(sa) > 0) & (F.size(sb) > 0), jaccard(sa, sb)).otherwise(F.lit(0.0))
    return F.when((na == "") & (nb == ""), street).otherwise(0.7 * street + 0.3 * F.when(na == nb, 1.0).otherwise(0.0))


def address_score(a: Column, b: Column) -> Column:
    return street_score(street_tokens(a), street_tokens(b), house_number(a), house_number(b))


def number_of(c: Column) -> Column:
    return F.replace(F.trim(c), F.lit(","), F.lit(".")).try_cast("double")


def numeric_score(a: Column, b: Column, tolerance: float) -> Column:
    """1 if equal, falling to 0 at the relative tolerance; null if a side is no number."""
    x, y = number_of(a), number_of(b)
    if tolerance <= 0:
        return F.when(x.isNull() | y.isNull(), F.lit(None)).when(x == y, 1.0).otherwise(0.0)
    off = F.abs(x - y) / F.greatest(F.abs(x), F.abs(y))
    return F.when(x.isNull() | y.isNull(), F.lit(None)).when(x == y, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - off / tolerance))


def ean_valid(c: Column) -> Column:
    """EAN-8 or EAN-13 with a right check digit."""
    s = F.trim(c)
    n = F.length(s)
    total = F.aggregate(
        F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), F.lit(0),
        lambda acc, i: acc + F.substr(s, i, F.lit(1)).try_cast("int") * F.when((n - i) % 2 == 1, 3).otherwise(1),
    )
    return F.when(s.rlike("^([0-9]{8}|[0-9]{13})$"), (10 - total % 10) % 10 == F.substr(s, n, F.lit(1)).try_cast("int")).otherwise(False)


def ean_score(a: Column, b: Column) -> Column:
    return F.when(ean_valid(a) & ean_valid(b), F.when(a == b, 1.0).otherwise(0.0))


def winkler(a: str, b: str) -> float:
    """Jaro similarity plus 0.1 for each of up to four common first letters, of the rest to 1."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    free = list(b)
    hits = []
    taken = [False] * len(b)
    for i, ch in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if not taken[j] and free[j] == ch), -1)
        if j >= 0:
            taken[j] = True
            hits.append(ch)
    if not hits:
        return 0.0
    other = [ch for ch, t in zip(b, taken) if t]
    swaps = sum(x != y for x, y in zip(hits, other)) / 2
    m = len(hits)
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + 0.1 * prefix * (1 - jaro)


@F.pandas_udf(T.DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else winkler(x, y) for x, y in zip(a, b)], dtype="float64")


# What is hidden in logs and previews.
SECRET_PATTERNS = (
    r"(?i)(authorization\s*[:=]\s*(?:bearer\s+|basic\s+)?)[^\s,;]+",
    r"(?i)(api[_-]?key\s*[:=]\s*)[^\s,;]+",
    r"(?i)(password\s*[=:]\s*)[^\s,;]+",
    r"(?i)(pwd\s*[=:]\s*)[^\s,;]+",
    r"(?i)(token\s*[=:]\s*)[^\s,;]+",
    r"(?i)(secret\s*[=:]\s*)[^\s,;]+",
)


def redact(c: Column) -> Column:
    for p in SECRET_PATTERNS:
        c = F.regexp_replace(c, p, "$1[REDACTED]")
    return c


# Words that set the level of a log line, strongest first.
LEVELS = {
    "fatal": "fatal|panic|critical|crit",
    "error": "error|err|fail|failed",
    "warn": "warn|warning",
    "debug": "debug|trace",
    "info": "info|notice|ok|success|succeeded",
}


def log_level(c: Column) -> Column:
    out = None
    for level, pattern in LEVELS.items():
        hit = F.lower(F.coalesce(c, F.lit(""))).rlike(pattern)
        out = F.when(hit, level) if out is None else out.when(hit, level)
    return out.otherwise("default")


def score_percent(c: Column) -> Column:
    """A score from 0 to 1 as whole percent, halves up."""
    return F.floor(c * 100 + 0.5).cast("long")


def parse_share(c: Column, default: float = 0.0) -> Column:
    """A share from 0 to 1: a fraction as it is, above 1 as percent; the default where the text is blank or no number."""
    v = F.coalesce(F.nullif(F.trim(c), F.lit("")).try_cast("double"), F.lit(float(default)))
    return F.least(F.greatest(F.when(v > 1, v / 100).otherwise(v), F.lit(0.0)), F.lit(1.0))


def byte_size(c: Column) -> Column:
    """A number of bytes as people read it: 512 B, 1.5 KiB."""
    n = c.cast("long")
    out = F.when(n.isNull() | (n <= 0), "0 B").when(n < 1024, F.format_string("%d B", n))
    for k, unit in enumerate("KMGTP", 1):
        out = out.when(n < 1024 ** (k + 1), F.format_string(f"%.1f {unit}iB", F.bround(n / F.lit(1024.0**k), 1)))
    return out.otherwise(F.format_string("%.1f EiB", F.bround(n / F.lit(1024.0**6), 1)))


def percent_of(used: Column, limit: Column) -> Column:
    """Whole percent used of a limit, from 0 to 100; 0 without a limit."""
    part = F.least(F.greatest(F.floor(F.try_divide(used * 100, limit)), F.lit(0)), F.lit(100)).cast("long")
    return F.when(limit > 0, part).otherwise(F.lit(0).cast("long"))


def trimmed(c: Column, most: int) -> Column:
    """Text without white space around it, marked where it was cut."""
    c = F.trim(c)
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, most), F.lit("\n[truncated]")))


def code_fence_body(c: Column) -> Column:
    """The body of a text that is one fenced block of Markdown, else the text without white space around it."""
    c = F.regexp_replace(c, r"^\s+|\s+$", "")
    return F.when(c.rlike(r"(?s)^```[^\n]*\n.*\n[ \t]*```[^\n]*$"), F.regexp_replace(F.regexp_extract(c, r"(?s)^```[^\n]*\n(.*)\n[ \t]*```[^\n]*$", 1), r"^\s+|\s+$", "")).otherwise(c)


def has_sql_word(c: Column, word: str) -> Column:
    """Whether a run of letters of the SQL text is the word, whatever the case."""
    return F.array_contains(F.split(F.upper(c), "[^A-Z]+"), word.upper())
