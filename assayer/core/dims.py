"""Small authored tables, rendered for Spark and for the SQL oracle alike.

Their size is fixed by the source code (hundreds of rows at most), so Catalyst
sees a local relation of known size and may broadcast it safely.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession


def _spark_literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return str(value)
    if isinstance(value, float):
        return f"{value!r}D"
    if isinstance(value, (list, tuple)):
        return "array(" + ", ".join(_spark_literal(v) for v in value) + ")"
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def sql_literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return str(value)
    if isinstance(value, float):
        return f"{value!r}::DOUBLE"
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(sql_literal(v) for v in value) + "]"
    return "'" + str(value).replace("'", "''") + "'"


def _rows(rows: Iterable[Sequence[object]], literal) -> str:
    return ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)


def dim(spark: SparkSession, columns: str, rows: Iterable[Sequence[object]]) -> DataFrame:
    """Build a local relation; ``columns`` is a comma-separated name list."""
    return spark.sql(f"SELECT * FROM VALUES {_rows(rows, _spark_literal)} AS t({columns})")


def dim_sql(columns: str, rows: Iterable[Sequence[object]]) -> str:
    return f"SELECT * FROM (VALUES {_rows(rows, sql_literal)}) AS t({columns})"
