"""Exact vector top-k: ``1 - (a <=> b) / 2`` per (query, chunk), best k per query.

Plan shape:
  queries (materialised, counted) -> if n_queries * dim * 8 fits the broadcast limit,
     one broadcast matrix; otherwise hash blocks of queries, each fitting it.
  chunks --mapInPandas--> per partition, per query, the candidates that can still be
     in the top k (numpy matrix product, no pair rows are produced)
  row_number per query over the candidates <= k (exact order: score desc, chunk_id asc)

The chunk table is scanned in place: it is never shuffled, and only
``partitions x queries x k`` candidate rows reach the final shuffle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom import constants as C
from ragloom.functions.numeric import round_half_up
from ragloom.operators import sizing
from ragloom.operators.lexical import RANK_DIGITS, top_k

_OUT = "query_id long, chunk_id long, score double"
_MARGIN = 1e-9  # keep near-ties; the exact order is decided by Spark on the rounded score


def _as_matrix(vectors: pd.Series, dim: int):
    """Stack a Series of vectors; rows that are NULL, of another width or of zero norm are dropped."""
    ok = np.fromiter(((v is not None and len(v) == dim) for v in vectors), dtype=bool, count=len(vectors))
    if not ok.any():
        return ok, np.zeros((0, dim))
    m = np.stack([np.asarray(v, dtype=np.float64) for v, good in zip(vectors, ok) if good])
    n = np.linalg.norm(m, axis=1)
    nz = n > 0
    full = ok.copy()
    full[ok] = nz
    return full, m[nz] / n[nz][:, None]


def _compact(cq: np.ndarray, cs: np.ndarray, cid: np.ndarray, k: int):
    """Keep, per query, every candidate whose score is within the margin of the k-th best."""
    if len(cs) == 0:
        return cq, cs, cid
    order = np.lexsort((-cs, cq))
    cq, cs, cid = cq[order], cs[order], cid[order]
    starts = np.r_[0, np.flatnonzero(np.diff(cq)) + 1]
    sizes = np.diff(np.r_[starts, len(cq)])
    kth = np.full(len(starts), -np.inf)
    has_k = sizes >= k
    kth[has_k] = cs[starts[has_k] + k - 1]
    thr = np.repeat(kth, sizes)
    keep = cs >= thr - _MARGIN
    return cq[keep], cs[keep], cid[keep]


def _scan(bc, k: int, dim: int, id_col: str, vec_col: str, block_rows: int):
    def fn(batches):
        qids, qm = bc.value
        nq = len(qids)
        cq = np.zeros(0, dtype=np.int64)
        cs = np.zeros(0)
        cid = np.zeros(0, dtype=np.int64)
        for pdf in batches:
            if nq == 0 or len(pdf) == 0:
                continue
            ok, xm = _as_matrix(pdf[vec_col], dim)
            ids = pdf[id_col].to_numpy(dtype=np.int64)[ok]
            for lo in range(0, len(ids), block_rows):
                x = xm[lo:lo + block_rows]
                s = (1.0 + x @ qm.T) / 2.0  # (rows, queries): 1 - (1 - cos) / 2
                if len(x) > k:
                    kth = np.partition(s, len(x) - k, axis=0)[len(x) - k]
                    r, q = np.nonzero(s >= kth - _MARGIN)
                else:
                    r, q = np.nonzero(np.ones_like(s, dtype=bool))
                cq = np.concatenate([cq, q.astype(np.int64)])
                cs = np.concatenate([cs, s[r, q]])
                cid = np.concatenate([cid, ids[lo:lo + block_rows][r]])
                if len(cs) > 2 * k * nq + 4096:
                    cq, cs, cid = _compact(cq, cs, cid, k)
        cq, cs, cid = _compact(cq, cs, cid, k)
        if len(cs):
            yield pd.DataFrame({"query_id": qids[cq], "chunk_id": cid, "score": cs})

    return fn


def _query_matrix(queries: DataFrame, id_col: str, vec_col: str, dim: int):
    pdf = queries.select(F.col(id_col).alias("qid"), F.col(vec_col).alias("vec")).toPandas()
    ok, qm = _as_matrix(pdf["vec"], dim)
    return pdf["qid"].to_numpy(dtype=np.int64)[ok], qm


def semantic_candidates(chunks: DataFrame, queries: DataFrame, k: int, *, dim: int,
                        chunk_id: str = "chunk_id", chunk_vec: str = "embedding",
                        query_id: str = "query_id", query_vec: str = "query_vec",
                        n_queries: int | None = None, broadcast_limit_bytes: int | None = None) -> DataFrame:
    """Per chunk partition, the rows that may be in a query's top ``k``: (query_id, chunk_id, score)."""
    spark = chunks.sparkSession
    limit = sizing.broadcast_limit(queries, broadcast_limit_bytes)
    n = queries.count() if n_queries is None else n_queries
    row_bytes = dim * 8 + 64 + 48 * k  # the vector, and the candidates a task holds for it
    n_blocks = max(1, -(-n * row_bytes // limit))
    block_rows = int(max(1, min(8192, (1 << 24) // max(1, min(n, limit // row_bytes)))))  # a score block has 2 ** 24 values at most
    src = chunks.select(F.col(chunk_id).cast("long").alias("chunk_id"), F.col(chunk_vec).alias("vec"))
    parts = []
    for b in range(n_blocks):
        qb = queries if n_blocks == 1 else queries.where(
            F.pmod(F.xxhash64(F.col(query_id)), F.lit(n_blocks)) == b)
        bc = spark.sparkContext.broadcast(_query_matrix(qb, query_id, query_vec, dim))
        part = src.mapInPandas(_scan(bc, k, dim, "chunk_id", "vec", block_rows), _OUT)
        if n_blocks > 1:  # one block at a time: its rows are written and its vectors freed
            part = sizing.materialize(part)
            bc.destroy()
        parts.append(part)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def semantic_topk(chunks: DataFrame, queries: DataFrame, k: int = C.SEMANTIC_CANDIDATES, *, dim: int,
                  score_col: str = "rank_semantic", **kw) -> DataFrame:
    """The ``k`` most similar chunks per query, ``score = 1 - cosine_distance / 2``."""
    cand = semantic_candidates(chunks, queries, k, dim=dim, **kw)
    cand = cand.select("query_id", "chunk_id", round_half_up("score", RANK_DIGITS).alias(score_col))
    return top_k(cand, k, score_col)


def vector_width(df: DataFrame, vec_col: str) -> int:
    """The width of the first non-NULL vector (one small job)."""
    row = df.where(F.col(vec_col).isNotNull()).select(F.size(vec_col).alias("d")).head(1)
    return int(row[0]["d"]) if row else 0
