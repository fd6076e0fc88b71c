"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ragloom.operators.sizing import materialize

__all__ = ["fresh", "global_rank", "materialize", "read", "text_bytes"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, each lengthened until no column of ``df`` has it (Spark ignores case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def text_bytes(column) -> list:
    """An Arrow string column as a list of UTF-8 bytes (None for null), undecoded."""
    return column.cast(pa.large_binary()).to_pylist()


def global_rank(df: DataFrame, *order: str, out: str = "rank") -> DataFrame:
    """Number all rows from 0 by the columns ``order``; ties get any order.

    One range exchange on ``order``; the sorted rows are written once, and each partition's
    rank base is read from the same copy. Only one row per partition meets in one task.
    """
    pid, mid, base, n = fresh(df, "_pid", "_mid", "_base", "_n")
    r = df.repartitionByRange(*order).sortWithinPartitions(*order)
    r = materialize(r.withColumn(mid, F.monotonically_increasing_id()))
    # monotonically_increasing_id: the partition in the upper bits, the place in it in the lower 33
    r = r.withColumn(pid, F.shiftright(mid, 33)).withColumn(mid, F.col(mid).bitwiseAND((1 << 33) - 1))
    counts = r.groupBy(pid).agg(F.count(F.lit(1)).alias(n))
    before = Window.orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(pid, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(base))
    # at most one row per shuffle partition, so this side's size is bounded by that setting
    return r.join(F.broadcast(bases), pid).withColumn(out, F.col(base) + F.col(mid)).drop(pid, mid, base)
