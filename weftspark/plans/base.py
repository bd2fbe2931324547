"""Where queries and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def listed(values) -> str:
    return "(" + ", ".join(map(quoted, values)) + ")"


def literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small stated table."""
    return spark.createDataFrame(rows, schema)


def values(rows: list[tuple], columns: str) -> str:
    """The same table in SQL; lists and None as they are."""

    def one(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, list):
            return "[" + ", ".join(map(one, v)) + "]"
        if isinstance(v, float):
            return f"{v!r}::DOUBLE"
        return quoted(v) if isinstance(v, str) else str(v)

    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) v({columns}))"
