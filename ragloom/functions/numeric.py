"""Rounding that both engines compute bit for bit.

``round()`` differs between engines on exact halves (decimal half-up on the
shortest decimal string in Spark, binary arithmetic elsewhere). Scores here are
reported and ranked through ``floor(x * 10^d + 0.5) / 10^d``, which is plain
IEEE arithmetic and therefore identical wherever the input double is.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(c, digits: int) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    scale = float(10 ** digits)
    return (F.floor(c.cast("double") * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale))


def round_half_up_sql(e: str, digits: int) -> str:
    scale = f"{float(10 ** digits)!r}"
    return f"(floor(CAST({e} AS DOUBLE) * {scale} + 0.5) / {scale})"
