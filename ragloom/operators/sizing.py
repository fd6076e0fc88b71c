"""Size checks that gate every broadcast, and lineage cuts.

A side is broadcast only when its row count, measured by a job, times a per-row
byte bound stays under the limit. Callers materialise small inputs first
(``materialize``) so the count reads written data instead of recomputing a plan.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession

DEFAULT_LIMIT = 128 * 1024 * 1024
_CONF = "ragloom.broadcast.limitBytes"


def broadcast_limit(df: DataFrame, limit: int | None = None) -> int:
    if limit is not None:
        return int(limit)
    try:
        return int(df.sparkSession.conf.get(_CONF, str(DEFAULT_LIMIT)))
    except Exception:  # noqa: BLE001
        return DEFAULT_LIMIT


def fits_broadcast(df: DataFrame, row_bytes: int, limit: int | None = None, n_rows: int | None = None) -> bool:
    n = df.count() if n_rows is None else n_rows
    return n * row_bytes <= broadcast_limit(df, limit)


def measured_bytes(df: DataFrame, *text_cols: str) -> int:
    """Rows times 16 bytes for each column, plus the length of the texts; one job."""
    from pyspark.sql import functions as F

    texts = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in text_cols), F.lit(0))
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(texts).alias("b")).first()
    return row.n * 16 * len(df.columns) + (row.b or 0)


def pieces(sizes, most):
    """Bounds of runs whose sizes add to at most ``most``, or of one item."""
    ends = np.cumsum(sizes)
    i = 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, side="right")))
        yield i, j
        i = j


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession):
    """Within, a write's shuffle files are deleted as soon as it has ended: its rows are stored, nobody reads them again."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


_MADE = threading.local()


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage by writing the rows as parquet under the session's checkpoint folder
    and reading them back: later scans prune columns and push filters like any stored
    table, and a lost executor re-reads files instead of recomputing the plan. zstd takes
    about a quarter less disk than the default codec for texts."""
    import uuid

    from ragloom.session import scratch_path

    path = scratch_path(df.sparkSession, f"tables/{uuid.uuid4().hex}")
    for made in getattr(_MADE, "lists", ()):
        made.append(path)
    with shuffles_freed(df.sparkSession):
        df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def stored(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """``materialize(make())``, and the tables that ``make`` wrote on the way are deleted. Nothing else may read those."""
    if not hasattr(_MADE, "lists"):
        _MADE.lists = []
    made: list[str] = []
    _MADE.lists.append(made)
    try:
        df = make()
    finally:
        _MADE.lists.remove(made)
    out = materialize(df)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for path in made:
        p = hadoop(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    return out
