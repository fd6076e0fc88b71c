"""Registered search queries (sections F, G, H) and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ragloom import constants as C
from ragloom.functions import text as T
from ragloom.functions import vectors as V
from ragloom.functions.numeric import round_half_up as rhu, round_half_up_sql as rhu_sql
from ragloom.operators import fusion, langdetect, lexical, sizing, stemming, stopwords, text_index, vector_search
from ragloom.plans.common import r6, r6_sql, register
from ragloom.plans.detect import detect_ctes
from ragloom.sources import fixtures as X
from ragloom.sources.tables import read_table



def _inputs(spark, sf_dir):
    """The chunk table (stored once, as a loader would) and the query batch."""
    ch = sizing.stored(spark, lambda: X.chunks(spark, sf_dir))
    q = sizing.materialize(X.search_queries(spark, sf_dir, ch))
    return ch, q


# ------------------------------------------------------------------ SQL building blocks

SEARCH_CTES = {
    "postings": (("chunks",), f"""
        SELECT chunk_id, unnest(tk) AS tok, generate_subscripts(tk, 1) AS pos
        FROM (SELECT chunk_id, {T.tokens_sql('content', True)} AS tk FROM chunks)"""),
    "qlex": (("queries",), f"""
        SELECT query_id, len(lx) AS n_lex, unnest(lx) AS tok, generate_subscripts(lx, 1) - 1 AS li
        FROM (SELECT query_id, list_distinct({T.tokens_sql(T.py_strip_sql('query_text'), False)}) AS lx
              FROM queries)"""),
    "occr": (("postings", "qlex"), """
        SELECT q.query_id, p.chunk_id, p.pos, q.li, q.n_lex,
               row_number() OVER (PARTITION BY q.query_id, p.chunk_id ORDER BY p.pos) AS r
        FROM postings p JOIN qlex q ON p.tok = q.tok"""),
    "lex_rank": (("occr", "qlex"), f"""
        SELECT query_id, chunk_id,
               {rhu_sql(f"sum(CASE WHEN prev_s IS NULL OR s > prev_s THEN {C.COVER_WEIGHT} / (1 + (e - s) - (re - rs)) ELSE 0 END)", 9)} AS rank_bm25
        FROM (
          SELECT *, lag(s) OVER (PARTITION BY query_id, chunk_id ORDER BY e) AS prev_s
          FROM (
            SELECT query_id, chunk_id, pos AS e, r AS re, any_value(n_lex) AS n_lex,
                   count(lastp) AS seen, min(lastp) AS s, min(lastr) AS rs
            FROM (
              SELECT o.query_id, o.chunk_id, o.pos, o.r, o.n_lex,
                     max(CASE WHEN o.li = l.li THEN o.pos END) OVER w AS lastp,
                     max(CASE WHEN o.li = l.li THEN o.r END) OVER w AS lastr
              FROM occr o JOIN qlex l ON o.query_id = l.query_id
              WINDOW w AS (PARTITION BY o.query_id, o.chunk_id, l.li ORDER BY o.pos
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
            ) GROUP BY query_id, chunk_id, pos, r
          ) WHERE seen = n_lex
        ) GROUP BY query_id, chunk_id"""),
    "lex_top": (("lex_rank",), f"""
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank_bm25 DESC, chunk_id) AS rank
                       FROM lex_rank) WHERE rank <= {C.LEXICAL_CANDIDATES}"""),
    "sem_all": (("queries", "chunks"), f"""
        SELECT q.query_id, c.chunk_id,
               {rhu_sql("(1.0 + list_cosine_similarity(c.embedding, q.query_vec)) / 2.0", 9)} AS rank_semantic
        FROM queries q JOIN chunks c ON len(c.embedding) = len(q.query_vec)
        WHERE list_dot_product(c.embedding, c.embedding) > 0 AND list_dot_product(q.query_vec, q.query_vec) > 0"""),
    "sem_top": (("sem_all",), f"""
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank_semantic DESC, chunk_id) AS rank
                       FROM sem_all) WHERE rank <= {C.SEMANTIC_CANDIDATES}"""),
    "fused": (("lex_top", "sem_top"), f"""
        SELECT coalesce(b.query_id, s.query_id) AS query_id, coalesce(b.chunk_id, s.chunk_id) AS chunk_id,
               coalesce(b.rank_bm25, 0.0) AS rank_bm25, coalesce(s.rank_semantic, 0.0) AS rank_semantic,
               {rhu_sql(f"{C.LEXICAL_WEIGHT} * coalesce(b.rank_bm25, 0.0) + {C.SEMANTIC_WEIGHT} * coalesce(s.rank_semantic, 0.0)", 9)}
                 AS final_rank
        FROM lex_top b FULL OUTER JOIN sem_top s ON b.query_id = s.query_id AND b.chunk_id = s.chunk_id"""),
}


def ctes(*names):
    return X.with_ctes(*names, extra=SEARCH_CTES)


def hybrid_sql(threshold: float, k: int = C.FUSED_TOP) -> str:
    return ctes("fused", "chunks") + f"""
        SELECT f.query_id, f.rank, f.chunk_id, c.source, c.page_number,
               {r6_sql('f.rank_bm25')} AS rank_bm25, {r6_sql('f.rank_semantic')} AS rank_semantic,
               {r6_sql('f.final_rank')} AS final_rank
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_rank DESC, chunk_id) AS rank
              FROM fused WHERE final_rank > {threshold}) f
        JOIN chunks c ON c.chunk_id = f.chunk_id
        WHERE f.rank <= {k}"""


# ------------------------------------------------------------------ Spark queries

def q_hybrid_search(spark, sf_dir, threshold=C.SCORE_THRESHOLD):
    ch, q = _inputs(spark, sf_dir)
    out = fusion.hybrid_search(ch, q, threshold=threshold, with_content=False, materialize_queries=False)
    return r6(out, "rank_bm25", "rank_semantic", "final_rank")


def q_hybrid_search_t05(spark, sf_dir):
    return q_hybrid_search(spark, sf_dir, threshold=0.5)


def q_lexical_match(spark, sf_dir):
    ch, q = _inputs(spark, sf_dir)
    return lexical.lexical_match(ch, q).select("query_id", "chunk_id")


def q_cover_density_rank(spark, sf_dir):
    ch, q = _inputs(spark, sf_dir)
    return r6(lexical.lexical_match(ch, q), "rank_bm25")


def q_lexical_topk(spark, sf_dir):
    ch, q = _inputs(spark, sf_dir)
    return r6(lexical.lexical_topk(ch, q), "rank_bm25")


def q_semantic_topk(spark, sf_dir):
    ch, q = _inputs(spark, sf_dir)
    dim = vector_search.vector_width(q, "query_vec")
    return r6(vector_search.semantic_topk(ch, q, dim=dim), "rank_semantic")


def q_hybrid_full_outer(spark, sf_dir):
    ch, q = _inputs(spark, sf_dir)
    dim = vector_search.vector_width(q, "query_vec")
    fused = fusion.fuse(lexical.lexical_topk(ch, q), vector_search.semantic_topk(ch, q, dim=dim))
    return r6(fused, "rank_bm25", "rank_semantic", "final_rank")


def q_hybrid_full_outer_content(spark, sf_dir):
    ch, q = _inputs(spark, sf_dir)
    dim = vector_search.vector_width(q, "query_vec")
    fused = fusion.fuse_by_content(lexical.lexical_topk(ch, q), vector_search.semantic_topk(ch, q, dim=dim), ch, shown=F.md5("content"))
    return r6(fused, "rank_bm25", "rank_semantic", "final_rank")


def q_index_lexical_match(spark, sf_dir):
    """From the stored index, as ``cover_density_rank``."""
    ch, q = _inputs(spark, sf_dir)
    return r6(text_index.lexical_match(text_index.build(ch), q), "rank_bm25")


def q_index_lexical_topk(spark, sf_dir):
    """From the stored index, blocks that can't reach the top left unread, as ``lexical_topk``."""
    ch, q = _inputs(spark, sf_dir)
    return r6(text_index.lexical_topk(text_index.build(ch), q), "rank_bm25")


def q_index_hybrid_search(spark, sf_dir):
    ch, q = _inputs(spark, sf_dir)
    out = fusion.hybrid_search(ch, q, with_content=False, materialize_queries=False, index=text_index.build(ch))
    return r6(out, "rank_bm25", "rank_semantic", "final_rank")


def _consecutive_pairs(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings")
    a, b = e.alias("a"), e.alias("b")
    return a.join(b, F.col("b.vec_id") == F.col("a.vec_id") + 1)


def q_cosine_distance(spark, sf_dir):
    p = _consecutive_pairs(spark, sf_dir)
    return p.select(F.col("a.vec_id").alias("vec_id"),
                    rhu(V.cosine_distance("a.embedding", "b.embedding"), 6).alias("distance"))


def q_semantic_score(spark, sf_dir):
    p = _consecutive_pairs(spark, sf_dir)
    return p.select(F.col("a.vec_id").alias("vec_id"),
                    rhu(V.semantic_score("a.embedding", "b.embedding"), 6).alias("rank_semantic"))


_PAIRS_SQL = "FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"

register("hybrid_search", q_hybrid_search, hybrid_sql(C.SCORE_THRESHOLD))
register("hybrid_search_t05", q_hybrid_search_t05, hybrid_sql(0.5))
register("lexical_match", q_lexical_match, ctes("lex_rank") + "SELECT query_id, chunk_id FROM lex_rank")
register("cover_density_rank", q_cover_density_rank,
         ctes("lex_rank") + f"SELECT query_id, chunk_id, {r6_sql('rank_bm25')} AS rank_bm25 FROM lex_rank")
register("lexical_topk", q_lexical_topk,
         ctes("lex_top") + f"SELECT query_id, chunk_id, {r6_sql('rank_bm25')} AS rank_bm25, rank FROM lex_top")
register("index_lexical_match", q_index_lexical_match,
         ctes("lex_rank") + f"SELECT query_id, chunk_id, {r6_sql('rank_bm25')} AS rank_bm25 FROM lex_rank")
register("index_lexical_topk", q_index_lexical_topk,
         ctes("lex_top") + f"SELECT query_id, chunk_id, {r6_sql('rank_bm25')} AS rank_bm25, rank FROM lex_top")
register("index_hybrid_search", q_index_hybrid_search, hybrid_sql(C.SCORE_THRESHOLD))
register("semantic_topk", q_semantic_topk,
         ctes("sem_top") + f"SELECT query_id, chunk_id, {r6_sql('rank_semantic')} AS rank_semantic, rank FROM sem_top")
register("hybrid_full_outer", q_hybrid_full_outer, ctes("fused") + f"""
         SELECT query_id, chunk_id, {r6_sql('rank_bm25')} AS rank_bm25, {r6_sql('rank_semantic')} AS rank_semantic,
                {r6_sql('final_rank')} AS final_rank FROM fused""")
register("hybrid_full_outer_content", q_hybrid_full_outer_content, ctes("lex_top", "sem_top", "chunks") + f"""
         SELECT coalesce(b.query_id, s.query_id) AS query_id, coalesce(b.source, s.source) AS source,
                md5(coalesce(b.content, s.content)) AS content, coalesce(b.page_number, s.page_number) AS page_number,
                {r6_sql('coalesce(b.rank_bm25, 0.0)')} AS rank_bm25, {r6_sql('coalesce(s.rank_semantic, 0.0)')} AS rank_semantic,
                {r6_sql(rhu_sql(f"{C.LEXICAL_WEIGHT} * coalesce(b.rank_bm25, 0.0) + {C.SEMANTIC_WEIGHT} * coalesce(s.rank_semantic, 0.0)", 9))} AS final_rank
         FROM (SELECT * FROM lex_top JOIN chunks USING (chunk_id)) b
         FULL OUTER JOIN (SELECT * FROM sem_top JOIN chunks USING (chunk_id)) s
           ON b.query_id = s.query_id AND b.source = s.source AND b.content = s.content AND b.page_number = s.page_number""")
register("cosine_distance", q_cosine_distance,
         f"SELECT a.vec_id, {rhu_sql(V.cosine_distance_sql('a.embedding', 'b.embedding'), 6)} AS distance {_PAIRS_SQL}")
register("semantic_score", q_semantic_score,
         f"SELECT a.vec_id, {rhu_sql(V.semantic_score_sql('a.embedding', 'b.embedding'), 6)} AS rank_semantic {_PAIRS_SQL}")


# ------------------------------------------------------------------ G6: approximate search (rows-only checks)

def _index(spark, sf):
    from ragloom.operators import ann

    ch, q = _inputs(spark, sf)
    index, centers = ann.build_ivf(ch)
    return ann.store_index(index), centers, ch, q


def q_ann_topk(spark, sf):
    """Lists are read until no other can hold a better row."""
    from ragloom.operators import ann

    index, centers, _, q = _index(spark, sf)
    return r6(ann.ann_topk(index, centers, q, radius=ann.radii(index, len(centers))), "rank_semantic")


def q_ann_topk_all_lists(spark, sf):
    """Probing every list is the exact search."""
    from ragloom.operators import ann

    index, centers, _, q = _index(spark, sf)
    return r6(ann.ann_topk(index, centers, q, C.SEMANTIC_CANDIDATES, n_probe=len(centers)), "rank_semantic")


def q_ann_recall(spark, sf):
    """With as many probes as some queries' exact results ask for."""
    from ragloom.operators import ann

    index, centers, ch, q = _index(spark, sf)
    exact = sizing.materialize(vector_search.semantic_topk(ch, q, dim=vector_search.vector_width(q, "query_vec")))
    top = ann.ann_topk(index, centers, q, n_probe=ann.probes_for(index, centers, exact, q))
    return r6(ann.recall_vs_exact(top, exact), "recall")


_SEM = ctes("sem_top") + f"SELECT query_id, chunk_id, {r6_sql('rank_semantic')} AS rank_semantic, rank FROM sem_top"
register("ann_topk", q_ann_topk, _SEM)
register("ann_topk_all_lists", q_ann_topk_all_lists, _SEM)
register("ann_recall", q_ann_recall, None)


# ------------------------------------------------------------------ F7: language-routed lexical search

def _config_inputs(spark, sf):
    ch = sizing.stored(spark, lambda: X.chunks(spark, sf).withColumn("config", T.language_config("language")))
    q = X.search_queries(spark, sf, ch)
    # a question's configuration is that of the language its own text is detected to have
    model = sizing.materialize(langdetect.train(read_table(spark, sf, "documents", spread_key="doc_id")))
    lang = langdetect.with_config(langdetect.detect(q, model, ["query_id"], text_col="query_text")).select("query_id", "config")
    return ch, sizing.materialize(q.join(lang, "query_id"))


def q_hybrid_search_config(spark, sf):
    ch, q = _config_inputs(spark, sf)
    out = fusion.hybrid_search(ch, q, threshold=0.5, with_content=False, materialize_queries=False,
                               config_col="config", query_config_col="config")
    return r6(out, "rank_bm25", "rank_semantic", "final_rank")


def q_lexical_match_config(spark, sf):
    ch, q = _config_inputs(spark, sf)
    return r6(lexical.lexical_match(ch, q, config_col="config", query_config_col="config"), "rank_bm25")


def _stems(ch, q):
    """The stems of all tokens of the chunks and the questions."""
    vocab = stemming.vocabulary(ch, "content").union(stemming.vocabulary(q, "query_text", fold_accents=False)).distinct()
    return stemming.dictionary(vocab)


def q_lexical_match_stems(spark, sf):
    """Matching by stems, from the stored index."""
    ch, q = _config_inputs(spark, sf)
    stems = _stems(ch, q)
    index = text_index.build(ch, config_col="config", stems=stems)
    return r6(text_index.lexical_match(index, q, query_config_col="config", stems=stems), "rank_bm25")


def q_text_vector_stems(spark, sf):
    ch = sizing.materialize(X.chunks(spark, sf).withColumn("config", T.language_config("language")))
    return stopwords.config_postings(ch, stems=stemming.dictionary(stemming.vocabulary(ch, "content")))


def _config_ctes(stems=False):
    d = dict(SEARCH_CTES)
    d["postings"] = (("chunks",), stopwords.config_postings_sql("chunks", stems))
    d.update(detect_ctes("queries", ("query_id",), "query_text", ("queries",)))
    kept = f"""(
        SELECT t.query_id, t.config, t.tok FROM (
          SELECT q.query_id, {T.language_config_sql('l.lang')} AS config,
                 unnest({T.tokens_sql(T.py_strip_sql('q.query_text'), False)}) AS tok
          FROM queries q LEFT JOIN best l ON l.query_id = q.query_id) t
        LEFT JOIN {stopwords.stop_values_sql()} sw ON sw.config = t.config AND sw.tok = t.tok
        WHERE sw.tok IS NULL)"""
    d["qlex"] = (("queries", "best"), f"""
        SELECT query_id, len(lx) AS n_lex, unnest(lx) AS tok, generate_subscripts(lx, 1) - 1 AS li FROM (
          SELECT query_id, list(DISTINCT tok) AS lx FROM {stemming.stem_table_sql(kept) if stems else kept} GROUP BY query_id)""")
    return d


def _hybrid_config_sql():
    return X.with_ctes("fused", "chunks", extra=_config_ctes()) + """
        SELECT f.query_id, f.rank, f.chunk_id, c.source, c.page_number,
               """ + f"""{r6_sql('f.rank_bm25')} AS rank_bm25, {r6_sql('f.rank_semantic')} AS rank_semantic,
               {r6_sql('f.final_rank')} AS final_rank
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_rank DESC, chunk_id) AS rank
              FROM fused WHERE final_rank > 0.5) f
        JOIN chunks c ON c.chunk_id = f.chunk_id
        WHERE f.rank <= {C.FUSED_TOP}"""


register("hybrid_search_config", q_hybrid_search_config, _hybrid_config_sql())
register("lexical_match_config", q_lexical_match_config, X.with_ctes("lex_rank", extra=_config_ctes()) +
         f"SELECT query_id, chunk_id, {r6_sql('rank_bm25')} AS rank_bm25 FROM lex_rank")
register("lexical_match_stems", q_lexical_match_stems, X.with_ctes("lex_rank", extra=_config_ctes(stems=True)) +
         f"SELECT query_id, chunk_id, {r6_sql('rank_bm25')} AS rank_bm25 FROM lex_rank")
register("text_vector_stems", q_text_vector_stems, X.with_ctes("chunks") + stopwords.config_postings_sql("chunks", stems=True))


# ------------------------------------------------------------------ D2 + H6: free-text questions end to end

TEXT_DIM = 64


def _text_inputs(spark, sf):
    """Benchmark texts as questions; chunk and question vectors from the hashed embedder
    (``passage: `` / ``query: `` prefixes), kept in double precision."""
    from ragloom.operators import embedding

    ch = X.chunks(spark, sf).drop("embedding")
    chunks = sizing.materialize(embedding.hash_embed(ch, "content", TEXT_DIM, prefix=C.PASSAGE_PREFIX, dtype="double"))
    b = read_table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    q = embedding.hash_embed(b, "query_text", TEXT_DIM, prefix=C.QUERY_PREFIX, out_col="query_vec",
                             dtype="double")
    return chunks, sizing.materialize(q)


def q_hybrid_search_text(spark, sf):
    ch, q = _text_inputs(spark, sf)
    out = fusion.hybrid_search(ch, q, threshold=0.5, with_content=False, materialize_queries=False)
    return r6(out, "rank_bm25", "rank_semantic", "final_rank")


def _sparse_sql(view: str, id_col: str, text_col: str, prefix: str, out_id: str) -> str:
    from ragloom.operators.embedding import hash_bucket_sql

    toks = T.tokens_sql(f"'{prefix}' || {text_col}", False)
    return f"""
        SELECT {out_id}, bucket, weight / sqrt(sum(weight * weight) OVER (PARTITION BY {out_id})) AS w
        FROM (SELECT {out_id}, {hash_bucket_sql('tok', TEXT_DIM)} AS bucket, count(*)::DOUBLE AS weight
              FROM (SELECT {id_col} AS {out_id}, unnest({toks}) AS tok FROM {view}) GROUP BY ALL)"""


def _text_ctes():
    d = dict(SEARCH_CTES)
    d["queries"] = ((), "SELECT item_id AS query_id, text AS query_text FROM benchmark")
    d["cw"] = (("chunks",), _sparse_sql("chunks", "chunk_id", "content", C.PASSAGE_PREFIX, "chunk_id"))
    d["qw"] = (("queries",), _sparse_sql("queries", "query_id", "query_text", C.QUERY_PREFIX, "query_id"))
    d["sem_all"] = (("queries", "chunks", "cw", "qw"), f"""
        SELECT q.query_id, c.chunk_id,
               {rhu_sql("(1.0 + coalesce(d.dot, 0.0)) / 2.0", 9)} AS rank_semantic
        FROM (SELECT DISTINCT query_id FROM qw) q CROSS JOIN (SELECT DISTINCT chunk_id FROM cw) c
        LEFT JOIN (SELECT qw.query_id, cw.chunk_id, sum(qw.w * cw.w) AS dot
                   FROM qw JOIN cw ON cw.bucket = qw.bucket GROUP BY ALL) d
          ON d.query_id = q.query_id AND d.chunk_id = c.chunk_id""")
    return d


register("hybrid_search_text", q_hybrid_search_text, X.with_ctes("fused", "chunks", extra=_text_ctes()) + f"""
        SELECT f.query_id, f.rank, f.chunk_id, c.source, c.page_number,
               {r6_sql('f.rank_bm25')} AS rank_bm25, {r6_sql('f.rank_semantic')} AS rank_semantic,
               {r6_sql('f.final_rank')} AS final_rank
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_rank DESC, chunk_id) AS rank
              FROM fused WHERE final_rank > 0.5) f
        JOIN chunks c ON c.chunk_id = f.chunk_id
        WHERE f.rank <= {C.FUSED_TOP}""")
