"""Named queries with their SQL. Doubles are rounded alike on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
PLACES = 6


def rounded(df: DataFrame, names: list[str], places: int) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), places) + 0.0 for c in names}) if names else df


def query(name: str, sql: str | None, doubles: str = "", places: int = PLACES) -> Callable[[Query], Query]:
    """Register a query; sql gives the same columns, and `doubles` names those to round (by spaces), to so many places."""
    names = doubles.split()

    def register(fn: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: rounded(fn(spark, sf_dir), names, places)
        if sql is not None:
            body = sql.strip()
            if names:
                replaced = ", ".join(f"round({c}, {places}) + 0.0 AS {c}" for c in names)
                body = f"SELECT * REPLACE ({replaced}) FROM ({body})"
            ORACLE[name] = body
        return fn

    return register
