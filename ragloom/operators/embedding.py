"""Embedding (D1-D3): a deterministic offline default and a pluggable model path.

Default: feature hashing. Tokens of ``prefix + text`` are counted per bucket
``int(md5(tok)[:8], 16) % dim`` and L2-normalised; all of it is DataFrame work
(explode, groupBy, join), so it partitions with the data. A user model plugs in
through ``model_embedder`` (Arrow batches via ``pandas_udf``).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as TY

from ragloom.functions import text as T
from ragloom.operators import sizing

AT_ONCE = 1 << 20  # buckets and vector places that a task counts at a time, or those of one text


def hash_bucket(tok, dim: int) -> Column:
    tok = F.col(tok) if isinstance(tok, str) else tok
    return F.conv(F.substring(F.md5(tok), 1, 8), 16, 10).cast("long") % F.lit(dim)


def hash_bucket_sql(e: str, dim: int) -> str:
    return f"(('0x' || substr(md5({e}), 1, 8))::BIGINT % {dim})"


def sparse_hash_vectors(df: DataFrame, id_cols: list[str], text_col: str, dim: int, prefix: str = "",
                        normalise: bool = True) -> DataFrame:
    """``(*id_cols, bucket, weight)`` for every non-empty bucket of each row's text."""
    txt = F.concat(F.lit(prefix), F.col(text_col)) if prefix else F.col(text_col)
    toks = df.select(*id_cols, F.explode(T.tokens(txt, fold_accents=False)).alias("tok"))
    counts = toks.groupBy(*id_cols, hash_bucket("tok", dim).alias("bucket")).agg(
        F.count(F.lit(1)).cast("double").alias("weight"))
    if not normalise:
        return counts
    norms = counts.groupBy(*id_cols).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    return counts.join(norms, id_cols).select(*id_cols, "bucket", (F.col("weight") / F.col("norm")).alias("weight"))


def _counted(rows: pa.Array, dim: int, kind) -> pa.Array:
    """Lists of buckets as vectors of unit length, a bounded number of buckets at a time; null where a list has none."""
    sizes = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    found, none = np.zeros((len(rows), dim), dtype=kind), np.ones(len(rows), dtype=bool)
    for i, j in sizing.pieces(sizes + dim, AT_ONCE):
        cells = np.repeat(np.arange(j - i) * dim, sizes[i:j]) + rows[i:j].flatten().to_numpy(zero_copy_only=False)
        weights = np.bincount(cells, minlength=(j - i) * dim).reshape(-1, dim).astype(float)
        norms = np.sqrt((weights * weights).sum(axis=1))
        found[i:j], none[i:j] = weights / np.where(norms > 0, norms, 1.0)[:, None], norms == 0
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * dim), pa.array(found.ravel()), mask=pa.array(none))


def hash_vector(text: Column, dim: int, dtype: str = "float") -> Column:
    """A text's dense hashed vector of unit length; NULL without a token. Buckets are SQL functions;
    an Arrow function counts them, a bounded number of a batch at a time, without any exchange."""
    buckets = F.transform(T.tokens(text, fold_accents=False), lambda t: hash_bucket(t, dim).cast("int"))

    def count(rows: pa.Array) -> pa.Array:
        return _counted(rows, dim, np.float32 if dtype == "float" else np.float64)

    return F.arrow_udf(count, f"array<{dtype}>")(buckets)


def hash_embed(df: DataFrame, text_col: str, dim: int, prefix: str = "", out_col: str = "embedding",
               dtype: str = "float") -> DataFrame:
    """D1/D2 default: adds dense hashed vectors (texts with no token get NULL), row by row.
    ``prefix`` is ``passage: `` for chunks and ``query: `` for questions."""
    txt = F.concat(F.lit(prefix), F.col(text_col)) if prefix else F.col(text_col)
    return df.withColumn(out_col, hash_vector(txt, dim, dtype))


def model_embedder(fn: Callable[[list[str]], np.ndarray], prefix: str = "") -> Callable[[Column], Column]:
    """Wrap a batch model ``fn(list_of_texts) -> (n, dim) array`` as a column function.

    Spark hands the model Arrow batches (``spark.sql.execution.arrow.maxRecordsPerBatch``
    rows at a time), the equivalent of the reference's insert batches.
    """

    @F.pandas_udf(TY.ArrayType(TY.FloatType()))
    def _embed(texts: pd.Series) -> pd.Series:
        out = np.asarray(fn([prefix + (t or "") for t in texts.tolist()]), dtype=np.float32)
        return pd.Series(list(out))

    return lambda c: _embed(F.col(c) if isinstance(c, str) else c)
