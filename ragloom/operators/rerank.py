"""Reranking (I1, I2): score (query, content) pairs, keep the best per query.

The default scorer is deterministic and JVM-side: the share of distinct query
tokens found in the content. A cross-encoder plugs in as ``model_scorer``
(Arrow batches of pairs through a ``pandas_udf``).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as TY

from ragloom import constants as C
from ragloom.functions import text as T


def token_overlap(query, content) -> Column:
    """|distinct query tokens present in content| / |distinct query tokens|; NULL for an empty query."""
    q = F.array_distinct(T.tokens(query, fold_accents=False))
    c = T.tokens(content, fold_accents=False)
    n = F.size(q)
    return F.when(n > 0, F.size(F.array_intersect(q, c)).cast("double") / n.cast("double"))


def token_overlap_sql(query: str, content: str) -> str:
    q = f"list_distinct({T.tokens_sql(query, False)})"
    c = T.tokens_sql(content, False)
    return f"(CASE WHEN len({q}) > 0 THEN len(list_intersect({q}, {c}))::DOUBLE / len({q})::DOUBLE END)"


def model_scorer(fn: Callable[[list[tuple[str, str]]], np.ndarray]) -> Callable[[Column, Column], Column]:
    """Wrap a batch pair scorer ``fn([(query, text), ...]) -> scores`` as a column function."""

    @F.pandas_udf(TY.DoubleType())
    def _score(q: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series(np.asarray(fn(list(zip(q.tolist(), t.tolist()))), dtype=np.float64))

    return lambda q, t: _score(q, t)


def rerank(hits: DataFrame, queries: DataFrame, top: int = C.RERANK_TOP, scorer=token_overlap,
           prior_col: str = "rank") -> DataFrame:
    """Per query, order hits by score desc (ties keep the prior order), keep ``top``.

    ``hits``: query_id, chunk_id, content, ``prior_col``; ``queries``: query_id, query_text.
    Adds ``score`` and ``rerank`` (1..top). An empty hit list stays empty.
    """
    if scorer is token_overlap:
        # tokenise each distinct hit chunk once (a chunk is usually in many queries' lists)
        ctoks = hits.select("chunk_id", "content").dropDuplicates(["chunk_id"]).select(
            "chunk_id", F.array_distinct(T.tokens("content", fold_accents=False)).alias("_ct"))
        qtoks = queries.select("query_id", F.array_distinct(T.tokens("query_text", fold_accents=False)).alias("_qt"))
        n = F.size("_qt")
        score = F.when(n > 0, F.size(F.array_intersect("_qt", "_ct")).cast("double") / n.cast("double"))
        # the question's few tokens go to the hits before the chunk's, so no exchange carries a chunk's tokens for each hit
        scored = hits.join(qtoks, "query_id").join(ctoks, "chunk_id").withColumn("score", score).drop("_ct", "_qt")
    else:
        j = hits.join(queries.select("query_id", "query_text"), "query_id")
        scored = j.withColumn("score", scorer(F.col("query_text"), F.col("content"))).drop("query_text")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc_nulls_last(), F.col(prior_col).asc())
    return scored.withColumn("rerank", F.row_number().over(w).cast("long")).where(F.col("rerank") <= top)
