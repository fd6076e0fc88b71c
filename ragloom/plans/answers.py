"""Registered reranking and answer-assembly queries (I, K) and their DuckDB twins.

Questions are the search queries; hits are the reranked top 10 of the hybrid
search at threshold 0.5, with ``source`` as a PDF file name. Answers and model
replies are fixtures derived from those tables (the model call itself is the
caller's: prompts out, answers in).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ragloom import constants as C
from ragloom.functions import text as T
from ragloom.operators import answer as A
from ragloom.operators import fusion, rerank, sizing
from ragloom.plans import search as S
from ragloom.plans.common import r6, r6_sql, register
from ragloom.sources import fixtures as X
from ragloom.sources.tables import read_table

HIT_THRESHOLD = 0.5


def _base(spark, sf):
    ch, q = S._inputs(spark, sf)
    h = fusion.hybrid_search(ch, q, threshold=HIT_THRESHOLD, with_content=True, materialize_queries=False)
    r = rerank.rerank(h, q)
    hits = sizing.materialize(r.withColumn("source", F.concat("source", F.lit(".pdf"))))
    return hits, q.select("query_id", "query_text")


def _answers(q):
    refuse = F.concat(F.lit("  "), F.upper(F.lit(C.NO_DOCS_TEMPLATE)), F.lit(" "))
    return q.select("query_id", F.when(F.col("query_id") % 5 == 0, refuse)
                    .otherwise(F.concat(F.lit("Answer about "), F.col("query_text"))).alias("answer"))


def _replies(hits, q):
    per_src = hits.groupBy("query_id", "source").agg(F.min("rerank").alias("first"))
    j = per_src.join(q, "query_id")
    item = F.concat(F.lit("Document: "), F.col("source"), F.lit("\nExplanation: it answers "),
                    F.col("query_text"), F.lit("\n\n"))
    body = j.groupBy("query_id").agg(
        A._ordered_join("first", item, "").alias("items"),
        F.min_by("source", "first").alias("first_source"))
    reply = F.concat(F.lit("Here is why each document matters:\n"), F.col("items"),
                     F.lit("Document - "), F.col("first_source"), F.lit("\n- restated.\n"))
    return body.select("query_id", reply.alias("reply"))


def q_rerank(spark, sf):
    hits, _ = _base(spark, sf)
    return r6(hits.select("query_id", "rerank", "chunk_id", "score", "rank"), "score")


def q_context_string(spark, sf):
    hits, q = _base(spark, sf)
    return A.context_string(hits, questions=q)


def q_chat_history(spark, sf):
    return A.chat_history(read_table(spark, sf, "conversations"))


def _history(spark, sf):
    """Question n continues the conversation n."""
    return A.chat_history(read_table(spark, sf, "conversations")).withColumnRenamed("conv_id", "query_id")


def q_history_append(spark, sf):
    hits, q = _base(spark, sf)
    turns = q.join(_answers(q), "query_id").join(A.context_string(hits, questions=q), "query_id", "left").select(
        "query_id", F.lit(0).cast("long").alias("turn"), F.col("query_text").alias("question"), "answer", "context")
    return A.history_append(turns, key="query_id")


def q_prompt_table(spark, sf):
    hits, q = _base(spark, sf)
    return A.prompt_table(q, A.context_string(hits, questions=q), _history(spark, sf), variant="chat")


def q_prompt_table_eval(spark, sf):
    hits, q = _base(spark, sf)
    return A.prompt_table(q, A.context_string(hits, questions=q), variant="eval")


def q_generate(spark, sf):
    hits, q = _base(spark, sf)
    prompts = A.prompt_table(q, A.context_string(hits, questions=q), variant="eval")
    return A.generate(prompts, A.repeat_question)


def q_refusal_flag(spark, sf):
    _, q = S._inputs(spark, sf)
    return A.refusal_flag(_answers(q))


def q_explain_prompt(spark, sf):
    hits, q = _base(spark, sf)
    return A.explain_prompt(hits, q)


def q_parse_explanations(spark, sf):
    hits, q = _base(spark, sf)
    return A.parse_explanations(_replies(hits, q))


def q_citation_block(spark, sf):
    hits, q = _base(spark, sf)
    return A.citation_block(hits, A.parse_explanations(_replies(hits, q)))


def q_final_answer(spark, sf):
    hits, q = _base(spark, sf)
    ans = _answers(q)
    cites = A.citation_block(hits, A.parse_explanations(_replies(hits, q)))
    return A.final_answer(ans, cites, A.refusal_flag(ans))


def q_source_list(spark, sf):
    hits, q = _base(spark, sf)
    return A.source_list(q, hits)


# ------------------------------------------------------------------ SQL twins

_OVERLAP = rerank.token_overlap_sql("q.query_text", "h.content")
ANSWER_CTES = dict(S.SEARCH_CTES)
ANSWER_CTES.update({
    "hyb": (("fused", "chunks"), f"""
        SELECT f.query_id, f.rank, f.chunk_id, c.source, c.page_number, c.content
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_rank DESC, chunk_id) AS rank
              FROM fused WHERE final_rank > {HIT_THRESHOLD}) f
        JOIN chunks c ON c.chunk_id = f.chunk_id WHERE f.rank <= {C.FUSED_TOP}"""),
    "hits": (("hyb", "queries"), f"""
        SELECT query_id, chunk_id, source || '.pdf' AS source, page_number, content, rank, score, rerank FROM (
          SELECT h.*, {_OVERLAP} AS score,
                 row_number() OVER (PARTITION BY h.query_id ORDER BY {_OVERLAP} DESC NULLS LAST, h.rank) AS rerank
          FROM hyb h JOIN queries q ON q.query_id = h.query_id) WHERE rerank <= {C.RERANK_TOP}"""),
    "ctx": (("hits", "queries"), f"""
        SELECT q.query_id, {T._lit_sql(C.CONTEXT_HEADER)} || coalesce(string_agg(
                 'Document ' || CAST(rerank - 1 AS VARCHAR) || chr(10) || content, '' ORDER BY rerank), '') AS context,
               count(h.query_id) AS n_hits
        FROM queries q LEFT JOIN hits h ON h.query_id = q.query_id GROUP BY q.query_id"""),
    "answers": (("queries",), f"""
        SELECT query_id, CASE WHEN query_id % 5 = 0 THEN '  ' || upper({T._lit_sql(C.NO_DOCS_TEMPLATE)}) || ' '
                              ELSE 'Answer about ' || query_text END AS answer FROM queries"""),
    "replies": (("hits", "queries"), """
        SELECT b.query_id, 'Here is why each document matters:' || chr(10) || b.items || 'Document - ' || b.first_source
               || chr(10) || '- restated.' || chr(10) AS reply
        FROM (SELECT p.query_id,
                     string_agg('Document: ' || p.source || chr(10) || 'Explanation: it answers ' || q.query_text
                                || chr(10) || chr(10), '' ORDER BY p.first) AS items,
                     arg_min(p.source, p.first) AS first_source
              FROM (SELECT query_id, source, min(rerank) AS first FROM hits GROUP BY ALL) p
              JOIN queries q ON q.query_id = p.query_id GROUP BY p.query_id) b"""),
    "expl": (("replies",), f"""
        SELECT query_id, doc, regexp_replace(text, '^[^a-zA-Z]*', '') AS explanation FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id, doc ORDER BY section DESC) AS r FROM (
            SELECT query_id, section, max(doc) AS doc,
                   coalesce(string_agg(CASE WHEN doc IS NULL
                        THEN {T.py_strip_sql(f"regexp_replace(line, '{A.EXPLANATION_LABEL}', '')")} || ' ' END,
                        '' ORDER BY ln), '') AS text
            FROM (
              SELECT *, sum(CASE WHEN doc IS NOT NULL THEN 1 ELSE 0 END)
                          OVER (PARTITION BY query_id ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section
              FROM (SELECT query_id, ln, line,
                           CASE WHEN regexp_matches(line, '{A.DOC_LINE}') THEN regexp_extract(line, '{A.DOC_LINE}', 1) END AS doc
                    FROM (SELECT query_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS ln
                          FROM (SELECT query_id, string_split(reply, chr(10)) AS ls FROM replies))))
            WHERE section > 0 GROUP BY query_id, section)) WHERE r = 1"""),
    "cites": (("hits", "expl"), f"""
        SELECT query_id, string_agg(entry, '' ORDER BY first) AS citations FROM (
          SELECT s.query_id, s.first,
                 {T._lit_sql(C.SOURCE_LINE_PREFIX)} || {T.short_title_sql('s.source')} || ': ' || s.links || chr(10) ||
                 {T._lit_sql(C.EXPLANATION_LINE_PREFIX)} ||
                 regexp_replace(coalesce(e.explanation, {T._lit_sql(C.NO_EXPLANATION)}), '^[^a-zA-Z]*', '') ||
                 chr(10) || chr(10) AS entry
          FROM (
            SELECT query_id, source, min(o) AS first,
                   string_agg('[pag.' || CAST(page AS VARCHAR) || '](' || '{C.VIEWER_BASE_URL}' || '?file=' ||
                              {T.url_quote_sql('source', True)} || '&page=' || CAST(page AS VARCHAR) || '&highlight=' ||
                              {T.double_url_encode_sql('snippet')} || ')', ', ' ORDER BY page, snippet) AS links
            FROM (SELECT query_id, source, page_number AS page,
                         {T.clean_snippet_sql(f"left(content, {C.CHUNK_SIZE})")} AS snippet, min(rerank) AS o
                  FROM hits GROUP BY ALL)
            GROUP BY query_id, source) s
          LEFT JOIN expl e ON e.query_id = s.query_id AND e.doc = s.source)
        GROUP BY query_id"""),
    "refusals": (("answers",), f"""
        SELECT query_id, {T.normalize_sql('answer')} = {T.normalize_sql(T._lit_sql(C.NO_DOCS_TEMPLATE))} AS refusal
        FROM answers"""),
})


def ctes(*names):
    return X.with_ctes(*names, extra=ANSWER_CTES)


_LINE = "CASE WHEN role = 'user' THEN 'user: ' ELSE 'assistant: ' END || text"
_HISTORY_SQL = f"""
    SELECT conv_id, CASE WHEN h = '' THEN {T._lit_sql(C.NO_HISTORY)} ELSE h END AS chat_history
    FROM (SELECT conv_id, string_agg({_LINE}, chr(10) ORDER BY turn) AS h FROM conversations GROUP BY conv_id)"""


def _prompt_sql(variant: str) -> str:
    if variant == "chat":
        sc, uc, sn, un = (C.CHAT_SYSTEM_WITH_CONTEXT, C.CHAT_USER_WITH_CONTEXT,
                          C.CHAT_SYSTEM_NO_CONTEXT, C.CHAT_USER_NO_CONTEXT)
    else:
        sc, uc, sn, un = (C.EVAL_SYSTEM_WITH_CONTEXT, C.EVAL_USER_WITH_CONTEXT,
                          C.EVAL_SYSTEM_NO_CONTEXT, C.EVAL_USER_NO_CONTEXT)
    hist = f"coalesce(h.chat_history, {T._lit_sql(C.NO_HISTORY)})" if variant == "chat" else T._lit_sql(C.NO_HISTORY)
    f = dict(context="x.context", chat_history=hist, question="q.query_text")
    return ctes("queries", "ctx") + f"""
        SELECT q.query_id, CASE WHEN x.n_hits > 0 THEN 'context' ELSE 'no_context' END AS template,
               CASE WHEN x.n_hits > 0 THEN {A.fill_sql(sc, **f)} ELSE {A.fill_sql(sn, **f)} END AS system_prompt,
               CASE WHEN x.n_hits > 0 THEN {A.fill_sql(uc, **f)} ELSE {A.fill_sql(un, **f)} END AS user_prompt
        FROM queries q JOIN ctx x ON x.query_id = q.query_id LEFT JOIN ({_HISTORY_SQL}) h ON h.conv_id = q.query_id"""


_EXPLAIN_ITEM = A.fill_sql(C.EXPLAIN_USER_ITEM, source="source", contents="contents")

register("rerank", q_rerank, ctes("hits") + f"SELECT query_id, rerank, chunk_id, {r6_sql('score')} AS score, rank FROM hits")
register("context_string", q_context_string, ctes("ctx") + "SELECT query_id, context, n_hits FROM ctx")
register("chat_history", q_chat_history, _HISTORY_SQL)
register("generate", q_generate, ctes("queries", "ctx") + "SELECT query_id, query_text AS answer FROM queries")
register("history_append", q_history_append, ctes("queries", "answers", "ctx") + """
    SELECT q.query_id, 1::BIGINT AS turn, 'user' AS role, q.query_text AS text FROM queries q
    UNION ALL
    SELECT q.query_id, 2::BIGINT AS turn, 'assistant' AS role, a.answer || chr(10) || chr(10) || x.context
    FROM queries q JOIN answers a ON a.query_id = q.query_id JOIN ctx x ON x.query_id = q.query_id""")
register("prompt_table", q_prompt_table, _prompt_sql("chat"))
register("prompt_table_eval", q_prompt_table_eval, _prompt_sql("eval"))
register("refusal_flag", q_refusal_flag, ctes("refusals") + "SELECT query_id, refusal FROM refusals")
register("explain_prompt", q_explain_prompt, ctes("hits", "queries") + f"""
    SELECT q.query_id, {T._lit_sql(C.EXPLAIN_SYSTEM)} AS system_prompt,
           {A.fill_sql(C.EXPLAIN_USER_HEAD, query='q.query_text')} || i.items AS user_prompt
    FROM queries q JOIN (
      SELECT query_id, string_agg({_EXPLAIN_ITEM}, '' ORDER BY first) AS items FROM (
        SELECT query_id, source, min(rerank) AS first,
               coalesce(string_agg(CASE WHEN k <= {C.EXPLAIN_CHUNKS_PER_SOURCE} THEN content END, chr(10) ORDER BY rerank), '')
                 AS contents
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY rerank) AS k FROM hits)
        GROUP BY query_id, source)
      GROUP BY query_id) i ON i.query_id = q.query_id""")
register("parse_explanations", q_parse_explanations, ctes("expl") + "SELECT query_id, doc, explanation FROM expl")
register("citation_block", q_citation_block, ctes("cites") + "SELECT query_id, citations FROM cites")
register("final_answer", q_final_answer, ctes("answers", "cites", "refusals") + """
    SELECT a.query_id, CASE WHEN c.citations IS NOT NULL AND NOT coalesce(r.refusal, false)
                            THEN a.answer || chr(10) || chr(10) || c.citations ELSE a.answer END AS final_answer
    FROM answers a LEFT JOIN cites c ON c.query_id = a.query_id LEFT JOIN refusals r ON r.query_id = a.query_id""")
register("source_list", q_source_list, ctes("queries", "hits") + f"""
    SELECT q.query_id, coalesce(s.sources, '{C.NO_SOURCES}') AS sources FROM queries q LEFT JOIN (
      SELECT query_id, string_agg('[' || source || ', {C.SOURCE_PAGE_LABEL} ' || CAST(page_number AS VARCHAR) || ']',
                                  chr(10) ORDER BY rerank) AS sources FROM hits GROUP BY query_id) s
      ON s.query_id = q.query_id""")
