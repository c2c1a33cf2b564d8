"""What a SQL text may do, decided from its tokens: a class for each statement, and gates for read-only use.

The gate knows foreign dialects' verbs too, so it works on tokens; for Spark's own dialect ``sources`` asks the parser.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

READ, WRITE, DDL, CALL, SCRIPT, UNKNOWN = "read_query", "write_dml", "ddl", "procedure_call", "script", "unknown"
VERBS = {
    READ: "SELECT SHOW DESCRIBE DESC VALUES".split(),
    WRITE: "INSERT UPDATE DELETE MERGE REPLACE TRUNCATE".split(),
    DDL: "CREATE DROP ALTER REFRESH GRANT REVOKE".split(),
    CALL: "CALL EXEC EXECUTE".split(),
}
# Settings whose mention makes a PRAGMA a write, and functions that act when called in a SELECT.
ACTING_PRAGMAS = "FOREIGN_KEYS JOURNAL_MODE SYNCHRONOUS LOCKING_MODE WRITABLE_SCHEMA AUTO_VACUUM CACHE_SIZE APPLICATION_ID USER_VERSION SCHEMA_VERSION WAL_CHECKPOINT OPTIMIZE".split()
ACTING_FUNCTIONS = "PG_TERMINATE_BACKEND PG_CANCEL_BACKEND PG_RELOAD_CONF SETVAL NEXTVAL SLEEP BENCHMARK LOAD_FILE".split()

_LEX = re.compile(
    r"""(?P<skip>--[^\n]*|/\*.*?(?:\*/|$)|\s+)|(?P<text>[eE]'(?:\\.|''|[^'\\])*'?|'(?:''|[^'])*'?|"(?:""|[^"])*"?|`(?:``|[^`])*`?|\[[A-Za-z_][^\]]*\])"""
    r"""|(?P<word>[A-Za-z_][A-Za-z0-9_]*)|(?P<sign>[();])|(?P<other>.)""",
    re.S,
)


def tokens(sql: str) -> list[str]:
    """Upper-cased words and ( ) ; without text, quoted names and comments."""
    return [m[0].upper() for m in _LEX.finditer(sql) if m.lastgroup in ("word", "sign")]


def is_script(sql: str) -> bool:
    """Whether anything stands behind a semicolon."""
    seen = False
    for m in _LEX.finditer(sql):
        if m.lastgroup == "sign" and m[0] == ";":
            seen = True
        elif seen and m.lastgroup != "skip":
            return True
    return False


def classify(sql: str) -> str:
    t = tokens(sql)
    if not [x for x in t if x != ";"]:
        return UNKNOWN
    return SCRIPT if is_script(sql) else _class(t)


def _class(t: list[str]) -> str:
    first = t[0]
    if first == "WITH":
        first = _cte_verb(t)
    if first == "EXPLAIN":
        rest = _analyzed(t)
        return _class(rest) if rest else READ
    if first == "PRAGMA":
        return WRITE if set(t[1:]) & set(ACTING_PRAGMAS) else READ
    kind = next((k for k, verbs in VERBS.items() if first in verbs), UNKNOWN)
    if kind == READ and any(a in ACTING_FUNCTIONS and b == "(" for a, b in zip(t, t[1:])):
        return WRITE
    return kind


def _cte_verb(t: list[str]) -> str:
    """The verb behind the CTEs; a writing verb at the head of any CTE makes the whole a write."""
    depth, main = 0, ""
    for a, b in zip(["", *t], t):
        if b in VERBS[WRITE] and (a == "(" or depth == 0):
            return b
        depth += (b == "(") - (b == ")")
        if depth == 0 and not main and b in (*VERBS[READ], *VERBS[DDL], *VERBS[CALL]):
            main = b
    return main or "WITH"


def _analyzed(t: list[str]) -> list[str]:
    """The statement that EXPLAIN ANALYZE runs; empty for a plain EXPLAIN."""
    if t[1:2] == ["ANALYZE"]:
        return t[2:]
    if t[1:2] == ["("] and ")" in t and "ANALYZE" in t[: t.index(")")]:
        return t[t.index(")") + 1 :]
    return []


def may_auto_run(sql: str, blocked: tuple[str, ...] = ()) -> bool:
    """One reading statement without blocked words."""
    return classify(sql) == READ and not set(tokens(sql)) & {b.upper() for b in blocked}


@dataclass(frozen=True)
class Gate:
    """Session rules: read-only use and hidden tables."""

    read_only: bool = False
    hidden_prefixes: tuple[str, ...] = ()

    def check(self, spark: SparkSession, sql: str) -> str:
        kind = classify(sql)
        if kind == SCRIPT:
            raise PermissionError("one statement at a time")
        if self.read_only and kind != READ:
            raise PermissionError(f"{kind} is not allowed in read-only mode")
        if kind == READ and self.hidden_prefixes:
            bad = [s for s in sources(spark, sql) if s.split(".")[-1].lower().startswith(self.hidden_prefixes)]
            if bad:
                raise PermissionError(f"hidden tables: {', '.join(bad)}")
        return kind


def sources(spark: SparkSession, sql: str) -> list[str]:
    """Tables that a statement reads, from the parsed plan; names of CTEs are left out."""
    parsed = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    found, ctes = [], set()

    def walk(p) -> None:
        kind = p.getClass().getSimpleName()
        if kind == "UnresolvedWith":
            it = p.cteRelations().iterator()
            while it.hasNext():
                c = it.next()
                ctes.add(c._1().lower())
                walk(c._2())
        if kind == "UnresolvedRelation":
            found.append(p.tableName().replace("`", ""))
        for seq in (p.children(), p.innerChildren()):
            it = seq.iterator()
            while it.hasNext():
                x = it.next()
                if "plans.logical" in x.getClass().getName() or "catalyst.analysis" in x.getClass().getName():
                    walk(x)
        exprs = p.expressions().iterator()
        while exprs.hasNext():
            _expr(exprs.next())

    def _expr(e) -> None:
        if hasattr(e, "plan") and "SubqueryExpression" in "".join(c.getName() for c in e.getClass().getInterfaces()) + e.getClass().getSuperclass().getName():
            walk(e.plan())
        it = e.children().iterator()
        while it.hasNext():
            _expr(it.next())

    walk(parsed)
    return sorted({s for s in found if s.lower() not in ctes})


@dataclass
class Window:
    """Some rows of a result."""

    rows: list
    columns: list[str]
    offset: int
    limit: int
    has_more: bool


def run_window(spark: SparkSession, sql: str, offset: int = 0, limit: int = 500, gate: Gate | None = None, args: list | dict | None = None) -> Window:
    """limit rows from offset on; one row more is read to tell whether others follow."""
    (gate or Gate()).check(spark, sql)
    limit = min(max(limit, 1), 5_000)
    df = page(spark.sql(sql, args) if args else spark.sql(sql), max(offset, 0), limit + 1)
    rows = df.collect()
    return Window(rows[:limit], df.columns, max(offset, 0), limit, len(rows) > limit)


def page(df: DataFrame, offset: int, limit: int, order: str | None = None, descending: bool = False) -> DataFrame:
    """A page; an order by an unknown column is ignored."""
    if order in df.columns:
        df = df.orderBy(F.desc(order) if descending else F.asc(order))
    return df.offset(offset).limit(limit)


# How types of other databases are classed, and what they are called there.
CLASS_WORDS = (("int", ("INT",)), ("float", ("REAL", "FLOA", "DOUB", "DEC", "NUM")), ("bool", ("BOOL",)))
TARGET_TYPES = {
    "spark": {"int": "BIGINT", "float": "DOUBLE", "bool": "BOOLEAN", "text": "STRING"},
    "postgres": {"int": "BIGINT", "float": "DOUBLE PRECISION", "bool": "BOOLEAN", "text": "TEXT"},
    "mysql": {"int": "BIGINT", "float": "DOUBLE", "bool": "BOOLEAN", "text": "TEXT"},
    "mssql": {"int": "BIGINT", "float": "FLOAT", "bool": "BIT", "text": "NVARCHAR(MAX)"},
    "sqlite": {"int": "INTEGER", "float": "REAL", "bool": "INTEGER", "text": "TEXT"},
}


def type_class(name: str) -> str:
    up = name.upper()
    if up.strip() == "BIT":
        return "bool"
    return next((k for k, words in CLASS_WORDS if any(w in up for w in words)), "text")


def target_type(name: str, dialect: str) -> str:
    return TARGET_TYPES[dialect][type_class(name)]


def quote(name: str, dialect: str = "spark") -> str:
    """A possibly dotted name, quoted for a dialect."""
    a, b = {"spark": "``", "mysql": "``", "mssql": "[]"}.get(dialect, '""')
    return ".".join(a + p.replace(b, b * 2) + b for p in name.split("."))
