"""Registered queries: one per operator of the coverage list, each with the
DuckDB SQL that computes the same table (when SQL can express it).

Every query reads the driver's parquet tables (through the fixtures) and
returns a DataFrame; doubles that are not exact sums are rounded to 6
decimals on both sides so that the engines' different summation orders do
not show.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name`` with its oracle SQL."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


# Added before rounding on both sides.  Our values are sums and means of
# integers whose exact binary expansions end within 8 fraction bits, so a
# value can sit exactly on a 6-decimal rounding boundary (27.5390625); the
# two engines' summation orders then put it on either side.  Shifted by
# 2^-28 no exact value lies on a boundary, and ulp-level noise is far below
# the shift.  The same literal appears in the oracle SQL.
ROUND_SHIFT = 2.0 ** -28


def r6(df: DataFrame, *cols: str) -> DataFrame:
    """Round the named double columns to 6 decimals (comparison form)."""
    return df.withColumns({c: F.round(F.col(c) + F.lit(ROUND_SHIFT), 6) for c in cols})
