"""Catalog views, row edits by new table versions, migration, and schema context for generated SQL."""

from __future__ import annotations

import re
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.operators.sqlgate import classify, quote, sources, target_type

_COUNTS: dict[str, tuple[float, int]] = {}
# Words of a question that name no table or column.
STOP_WORDS = frozenset(
    "and are asc bei das der die for from how ich mit not oder select show sql the und was wer where with wie von".split()
)


def objects(spark: SparkSession, hidden: tuple[str, ...] = ()) -> DataFrame:
    """name, kind of tables and views, without hidden prefixes, by name."""
    rows = [(t.name, "view" if t.isTemporary or t.tableType == "VIEW" else "table") for t in spark.catalog.listTables() if not t.name.lower().startswith(hidden or ("\0",))]
    return spark.createDataFrame(sorted(rows, key=lambda r: r[0].lower()), "name string, kind string")


def row_count(spark: SparkSession, name: str, ttl: float = 5.0) -> int:
    """The row count, at most ``ttl`` seconds old."""
    now = time.monotonic()
    if name not in _COUNTS or now - _COUNTS[name][0] > ttl:
        _COUNTS[name] = (now, spark.table(name).count())
    return _COUNTS[name][1]


def structure(spark: SparkSession, name: str) -> DataFrame:
    """position, name, type, nullable, as PRAGMA table_info tells it."""
    return spark.createDataFrame([(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(spark.table(name).schema.fields)], "position int, name string, type string, nullable boolean")


def create_table(spark: SparkSession, name: str, columns: dict[str, str]) -> None:
    """A table of columns by name and type of any dialect; the column id, whole numbers, is always there and comes first."""
    rest = {n: t for n, t in columns.items() if n.lower() != "id"}
    cols = ", ".join([f"{quote('id')} BIGINT", *(f"{_one(n)} {target_type(t, 'spark')}" for n, t in rest.items())])
    spark.sql(f"CREATE TABLE {quote(name)} ({cols}) USING parquet")


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE {quote(name)}")
    _COUNTS.pop(name, None)


def create_view(spark: SparkSession, name: str, sql: str, replace: bool = False) -> None:
    """A stored view of one read query."""
    if classify(sql) != "read_query":
        raise PermissionError("a view is one read query")
    spark.sql(f"CREATE {'OR REPLACE ' if replace else ''}VIEW {quote(name)} AS {sql.strip().rstrip(';')}")


def view_script(spark: SparkSession, name: str, alter: bool = False) -> str:
    """The statement that makes a stored view, or that changes it."""
    rows = {r[0]: r[1] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {quote(name)}").collect()}
    if rows.get("Type") != "VIEW":
        raise ValueError(f"{name} is no stored view")
    return f"{'ALTER' if alter else 'CREATE'} VIEW {quote(name)} AS {rows['View Text']}"


def _one(name: str) -> str:
    """One name, quoted whole, dots and all."""
    return "`" + name.replace("`", "``") + "`"


def dependencies(spark: SparkSession, views: dict[str, str]) -> DataFrame:
    """Edges (object, uses) of view definitions."""
    return spark.createDataFrame(sorted((v, s) for v, sql in views.items() for s in sources(spark, sql)), "object string, uses string")


def script(name: str, columns: list[str], kind: str = "select") -> str:
    cols = ", ".join(f"`{c}`" for c in columns)
    return {
        "select": f"SELECT {cols} FROM `{name}` LIMIT 1000",
        "insert": f"INSERT INTO `{name}` ({cols}) VALUES ({', '.join(':' + c for c in columns)})",
        "update": f"UPDATE `{name}` SET {', '.join(f'`{c}` = :{c}' for c in columns if c != 'id')} WHERE `id` = :id",
    }[kind]


def _replace(spark: SparkSession, name: str, df: DataFrame) -> None:
    """A new version of the table takes the place of the old one."""
    tmp = f"{name}_{uuid.uuid4().hex[:8]}"
    df.write.saveAsTable(tmp)
    spark.sql(f"DROP TABLE `{name}`")
    spark.sql(f"ALTER TABLE `{tmp}` RENAME TO `{name}`")
    _COUNTS.pop(name, None)


def insert(spark: SparkSession, name: str, row: dict) -> int:
    """Appends a row under the next id; one writer at a time."""
    t = spark.table(name)
    new = (t.agg(F.max("id")).first()[0] or 0) + 1
    vals = {**row, "id": new}
    spark.range(1).select(*[F.lit(vals.get(f.name)).cast(f.dataType).alias(f.name) for f in t.schema.fields]).write.mode("append").saveAsTable(name)
    _COUNTS.pop(name, None)
    return new


def update(spark: SparkSession, name: str, row_id: object, values: dict) -> None:
    t = spark.table(name)
    hit = F.col("id") == F.lit(row_id)
    _replace(spark, name, t.select(*[(F.when(hit, F.lit(values[f.name]).cast(f.dataType)).otherwise(F.col(f.name)) if f.name in values else F.col(f.name)).alias(f.name) for f in t.schema.fields]))


def delete(spark: SparkSession, name: str, row_id: object) -> None:
    _replace(spark, name, spark.table(name).where(~F.col("id").eqNullSafe(F.lit(row_id))))


def parse_id(text: str) -> int | str:
    return int(text) if re.fullmatch(r"-?[0-9]{1,18}", text) else text


def migrate(source: DataFrame, target: str, create: bool = True, jdbc: dict[str, str] | None = None, batch: int = 10_000) -> None:
    """Copies a table into a managed table, or in batches into another database."""
    if jdbc:
        source.write.format("jdbc").options(**jdbc, dbtable=target, batchsize=str(batch)).mode("append").save()
    elif create:
        source.write.mode("append").saveAsTable(target)
    else:
        source.write.insertInto(target)


def query_words(text: str) -> list[str]:
    found = (w.strip("_") for w in re.findall(r"[\w]+", text.lower()))
    return sorted({w for w in found if len(w.encode()) >= 2 and w not in STOP_WORDS})


def schema_context(spark: SparkSession, question: str, max_tables: int = 8, samples: int = 3) -> list[dict]:
    """The tables whose names and columns fit a question best, with a few sample values of each column."""
    words = query_words(question)

    def score(name: str, cols: list[str]) -> int:
        total = 0
        for w in words:
            total += 8 if w == name.lower() else 4 if w in name.lower() else 0
            total += sum(5 if w == c.lower() else 2 if w in c.lower() else 0 for c in cols)
        return total

    tables = [(t.name, spark.table(t.name).columns) for t in spark.catalog.listTables()]
    best = sorted(tables, key=lambda t: (-score(*t), t[0].lower()))[:max_tables]
    out = []
    for name, cols in best:
        rows = spark.table(name).limit(samples).collect()
        out.append({"table": name, "columns": [{"name": c, "samples": [r[c] for r in rows]} for c in cols]})
    return out


def register_context_function(spark: SparkSession, max_tables: int = 8) -> None:
    """agent_context() as a table function: (position, line) of the tables and columns in the catalog when it was registered."""
    from pyspark.sql.functions import udtf

    lines = []
    for t in sorted(spark.catalog.listTables(), key=lambda t: t.name.lower())[:max_tables]:
        lines.append(f"{t.name}({', '.join(f'{f.name} {f.dataType.simpleString()}' for f in spark.table(t.name).schema.fields)})")

    @udtf(returnType="position int, line string")
    class AgentContext:
        def eval(self, max_chars: int):
            left = max_chars
            for i, line in enumerate(lines):
                if left <= 0:
                    return
                yield i, line[:left]
                left -= len(line)

    spark.udtf.register("agent_context", AgentContext)
