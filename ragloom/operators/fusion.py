"""Hybrid fusion: full outer join of the lexical and semantic lists, weighted sum,
threshold, top-k, then chunk metadata attached by a size-checked broadcast join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragloom import constants as C
from ragloom.functions.numeric import round_half_up
from ragloom.operators import sizing, text_index
from ragloom.operators.lexical import RANK_DIGITS, lexical_topk, top_k
from ragloom.operators.vector_search import semantic_topk, vector_width


def fuse(lex: DataFrame, sem: DataFrame, w_lex: float = C.LEXICAL_WEIGHT, w_sem: float = C.SEMANTIC_WEIGHT,
         keys: tuple[str, ...] = ("query_id", "chunk_id")) -> DataFrame:
    """H1-H3: full outer join on the keys, missing scores as 0, ``final_rank = w_lex*b + w_sem*s``."""
    j = lex.select(*keys, "rank_bm25").join(sem.select(*keys, "rank_semantic"), list(keys), "full_outer")
    b = F.coalesce(F.col("rank_bm25"), F.lit(0.0))
    s = F.coalesce(F.col("rank_semantic"), F.lit(0.0))
    return j.select(*keys, b.alias("rank_bm25"), s.alias("rank_semantic"),
                    round_half_up(F.lit(w_lex) * b + F.lit(w_sem) * s, RANK_DIGITS).alias("final_rank"))


def fuse_by_content(lex: DataFrame, sem: DataFrame, chunks: DataFrame, shown: Column | None = None, **weights) -> DataFrame:
    """H1 with the content key: both lists joined on (source, content, page_number), so equal chunks of a
    page meet in every combination.

    Hits don't carry texts: a content's SHA-256 stands for it in the joins. ``shown``, an expression of ``content`` that is null
    only where the content is, is what the result has as ``content``; without it, the texts join the result last, each once."""
    digest = F.sha2(F.col("content"), 256).alias("_digest")
    named = sizing.materialize(chunks.select("chunk_id", "source", "page_number", digest, *([shown.alias("_shown")] if shown is not None else [])))
    keys = ("query_id", "source", "_digest", "page_number", *(("_shown",) if shown is not None else ()))
    fused = fuse(lex.join(named, "chunk_id"), sem.join(named, "chunk_id"), keys=keys, **weights)
    if shown is None:
        texts = chunks.where("content is not null").groupBy(digest).agg(F.first("content").alias("_shown"))
        fused = fused.join(texts, "_digest", "left")
    return fused.select("query_id", "source", F.col("_shown").alias("content"), "page_number", "rank_bm25", "rank_semantic", "final_rank")


def attach(hits: DataFrame, chunks: DataFrame, cols=("source", "content", "page_number"),
           n_hits_bound: int | None = None) -> DataFrame:
    """Chunk columns for a small hit list. The hit list is broadcast when its row bound
    fits (the chunk table then streams through without a shuffle); otherwise a shuffle join."""
    meta = chunks.select("chunk_id", *cols)
    small = n_hits_bound is not None and sizing.fits_broadcast(hits, row_bytes=96, n_rows=n_hits_bound)
    right = F.broadcast(hits) if small else hits
    return meta.join(right, "chunk_id")


def hybrid_search(chunks: DataFrame, queries: DataFrame, *, k_lex: int = C.LEXICAL_CANDIDATES,
                  k_sem: int = C.SEMANTIC_CANDIDATES, w_lex: float = C.LEXICAL_WEIGHT,
                  w_sem: float = C.SEMANTIC_WEIGHT, threshold: float = C.SCORE_THRESHOLD,
                  k: int = C.FUSED_TOP, dim: int | None = None, with_content: bool = True,
                  materialize_queries: bool = True, index: DataFrame | None = None, **kw) -> DataFrame:
    """H6: lexical top-``k_lex`` and semantic top-``k_sem`` per query, fused, kept when
    ``final_rank > threshold``, best ``k`` per query.

    ``chunks``: chunk_id, source, page_number, content, embedding.
    ``queries``: query_id, query_text, query_vec.
    ``index``: the chunks' stored text index (``text_index``); with it the lexical side reads no chunk text.
    Returns query_id, rank, chunk_id, source, page_number, [content,] rank_bm25,
    rank_semantic, final_rank.
    """
    if materialize_queries:
        qcols = ["query_id", "query_text", "query_vec"] + ([kw["query_config_col"]] if kw.get("query_config_col") else [])
        queries = sizing.materialize(queries.select(*qcols))
    n_q = queries.count()
    dim = dim or vector_width(queries, "query_vec")
    if index is not None:
        lex = text_index.lexical_topk(index, queries, k_lex, **{n: v for n, v in kw.items() if n != "config_col"})
    else:
        lex = lexical_topk(chunks, queries, k_lex, **kw)
    sem = semantic_topk(chunks, queries, k_sem, dim=dim, n_queries=n_q)
    fused = fuse(lex, sem, w_lex, w_sem).where(F.col("final_rank") > F.lit(threshold))
    best = top_k(fused, k, "final_rank")
    cols = ("source", "page_number", "content") if with_content else ("source", "page_number")
    out = attach(best, chunks, cols, n_hits_bound=n_q * k)
    return out.select("query_id", "rank", "chunk_id", *cols, "rank_bm25", "rank_semantic", "final_rank")
