"""The named queries and the SQL each is checked with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from billwright.sources import derived

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` may name derived tables as ``{table}``."""

    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = derived.oracle(sql)
        return fn

    return register


def dates_as_text(df: DataFrame) -> DataFrame:
    """Dates and times as text and decimals as doubles, for comparable output."""
    out = []
    for field in df.schema.fields:
        kind = field.dataType.typeName()
        if kind in ("date", "timestamp", "timestamp_ntz"):
            out.append(f"cast(`{field.name}` as string) AS `{field.name}`")
        elif kind.startswith("decimal"):
            out.append(f"cast(`{field.name}` as double) AS `{field.name}`")
        else:
            out.append(f"`{field.name}`")
    return df.selectExpr(*out)
