"""Shared helpers for registered queries and their oracle SQL."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom.functions.numeric import round_half_up, round_half_up_sql

OUT_DIGITS = 6


def r6(df: DataFrame, *cols: str) -> DataFrame:
    """Round the named double columns to the reported precision."""
    return df.select(*[round_half_up(c, OUT_DIGITS).alias(c) if c in cols else F.col(c) for c in df.columns])


def r6_sql(e: str) -> str:
    return round_half_up_sql(e, OUT_DIGITS)


@lru_cache(maxsize=None)
def _registry():
    return {}


def register(name: str, spark_fn, sql: str | None):
    """Add one query: ``spark_fn(spark, sf_dir) -> DataFrame`` and its DuckDB twin (or None)."""
    _registry()[name] = (spark_fn, sql)
    return spark_fn


def registry() -> dict:
    return _registry()
