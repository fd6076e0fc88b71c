"""Registered evaluation queries (L) and their DuckDB twins.

Answer metrics use the (question, reference, prediction) fixture from conversations;
ranking metrics use the hybrid search hits at threshold 0.5 with "same document,
other page" as the relevance rule.
"""

from __future__ import annotations

from ragloom import constants as C
from ragloom.functions import text as T
from ragloom.operators import fusion
from ragloom.operators import metrics as M
from ragloom.plans import search as S
from ragloom.plans.common import r6, r6_sql, register
from ragloom.sources import fixtures as X

K_RECALL = 10


def _pairs(spark, sf):
    return X.predictions(spark, sf)


def q_bleu(spark, sf):
    return r6(M.bleu(_pairs(spark, sf)), "bleu", "p1", "p2", "p3", "p4", "bp")


def q_rouge_n(spark, sf):
    return r6(M.rouge_n(_pairs(spark, sf)), "rouge1_f1", "rouge2_f1")


def q_rouge_l(spark, sf):
    return r6(M.rouge_l(_pairs(spark, sf)), "rougeL_f1")


def q_rouge_resampled(spark, sf):
    return r6(M.rouge_resampled(_pairs(spark, sf)), "low", "mid", "high")


def q_greedy_match_score(spark, sf):
    return r6(M.greedy_match_score(_pairs(spark, sf)), "greedy_precision", "greedy_recall", "greedy_f1")


def _ranked(spark, sf):
    ch, q = S._inputs(spark, sf)
    hits = fusion.hybrid_search(ch, q, threshold=0.5, with_content=False, materialize_queries=False)
    return M.relevance_by_group(hits.select("query_id", "chunk_id", "rank"), ch, q)


def q_recall_at_k(spark, sf):
    flagged, n_rel = _ranked(spark, sf)
    return r6(M.recall_at_k(flagged, n_rel, K_RECALL), "recall")


def q_mrr(spark, sf):
    flagged, n_rel = _ranked(spark, sf)
    return r6(M.mrr(flagged, n_rel), "mrr")


def q_eval_report(spark, sf):
    return r6(M.eval_report(_pairs(spark, sf)), *M.REPORT_COLUMNS[4:])


# ------------------------------------------------------------------ SQL twins

def _overlap_sql(tok_sql, orders) -> str:
    arr = "[" + ", ".join(str(n) for n in orders) + "]"
    grams = "list_transform(range(1, len(t) - n + 2), lambda i: array_to_string(t[i:i + n - 1], ' '))"
    side = lambda col: f"""
        SELECT qid, n, gram, count(*) AS c FROM (
          SELECT qid, n, unnest({grams}) AS gram FROM (
            SELECT qid, t, unnest({arr}) AS n FROM (SELECT qid, {tok_sql(col)} AS t FROM predictions))
          WHERE len(t) >= n)
        GROUP BY ALL"""
    return f"""
        SELECT b.qid, b.n, coalesce(m.match, 0) AS match, greatest(b.lp - b.n + 1, 0) AS pred_n,
               greatest(b.lr - b.n + 1, 0) AS ref_n, b.lp, b.lr
        FROM (SELECT qid, len({tok_sql('prediction')}) AS lp, len({tok_sql('reference')}) AS lr, unnest({arr}) AS n
              FROM predictions) b
        LEFT JOIN (SELECT p.qid, p.n, sum(least(p.c, r.c)) AS match
                   FROM ({side('prediction')}) p JOIN ({side('reference')}) r
                     ON p.qid = r.qid AND p.n = r.n AND p.gram = r.gram
                   GROUP BY p.qid, p.n) m ON m.qid = b.qid AND m.n = b.n"""


def bleu_sql(max_order: int = 4) -> str:
    sums = ", ".join(f"sum(CASE WHEN n = {i} THEN match END) AS m{i}, sum(CASE WHEN n = {i} THEN pred_n END) AS poss{i}"
                     for i in range(1, max_order + 1))
    ps = ", ".join(f"CASE WHEN poss{i} > 0 THEN m{i} / poss{i} ELSE 0.0 END AS p{i}" for i in range(1, max_order + 1))
    pl = [f"p{i}" for i in range(1, max_order + 1)]
    geo = (f"CASE WHEN least({', '.join(pl)}) > 0 THEN exp(0 + " +
           " + ".join(f"{1.0 / max_order!r} * ln({p})" for p in pl) + ") ELSE 0.0 END")
    ratio = "(pred_len / ref_len)"
    bp = f"CASE WHEN {ratio} > 1.0 THEN 1.0 ELSE exp(1.0 - 1.0 / {ratio}) END"
    return X.with_ctes("predictions") + f"""
        SELECT {r6_sql(f'({geo}) * ({bp})')} AS bleu, {', '.join(f'{r6_sql(p)} AS {p}' for p in pl)},
               {r6_sql(bp)} AS bp, CAST(pred_len AS BIGINT) AS pred_len, CAST(ref_len AS BIGINT) AS ref_len
        FROM (SELECT *, {ps} FROM (
          SELECT {sums}, sum(CASE WHEN n = 1 THEN lp END) AS pred_len, sum(CASE WHEN n = 1 THEN lr END) AS ref_len
          FROM ({_overlap_sql(M.bleu_tokens_sql, range(1, max_order + 1))})))"""


def rouge_sql() -> str:
    p = "match / greatest(pred_n, 1)"
    r = "match / greatest(ref_n, 1)"
    f = f"CASE WHEN {p} + {r} > 0 THEN 2.0 * ({p}) * ({r}) / (({p}) + ({r})) ELSE 0.0 END"
    return f"""
        SELECT qid, max(CASE WHEN n = 1 THEN f END) AS rouge1_f1, max(CASE WHEN n = 2 THEN f END) AS rouge2_f1
        FROM (SELECT qid, n, {f} AS f FROM ({_overlap_sql(M.rouge_tokens_sql, (1, 2))})) GROUP BY qid"""


def greedy_sql(dim: int = 64, rounded: bool = True) -> str:
    """L4 twin: token-occurrence means of best trigram-vector cosine, both directions."""
    from ragloom.operators.embedding import hash_bucket_sql

    grams = "list_transform(range(1, length('<' || tok || '>') - 1), lambda k: substring('<' || tok || '>', k, 3))"
    rd = r6_sql if rounded else (lambda e: e)
    return f""",
    tp AS (SELECT qid, unnest({M.rouge_tokens_sql('prediction')}) AS tok FROM predictions),
    tr AS (SELECT qid, unnest({M.rouge_tokens_sql('reference')}) AS tok FROM predictions),
    vocab AS (SELECT tok FROM tp UNION SELECT tok FROM tr),
    tg AS (SELECT tok, {hash_bucket_sql('gram', dim)} AS bucket, count(*)::DOUBLE AS c
           FROM (SELECT tok, unnest({grams}) AS gram FROM vocab) GROUP BY ALL),
    tn AS (SELECT tok, bucket, c / sqrt(sum(c * c) OVER (PARTITION BY tok)) AS w FROM tg),
    tv AS (SELECT tok, list_transform(range(0, {dim}), lambda k: coalesce(list_sum(list_transform(
               list_filter(e, lambda x: x.b = k), lambda x: x.w)), 0.0)) AS v
           FROM (SELECT tok, list({{'b': bucket, 'w': w}}) AS e FROM tn GROUP BY tok)),
    pairs AS (SELECT a.qid, a.tok AS ta, b.tok AS tb
              FROM (SELECT DISTINCT qid, tok FROM tp) a JOIN (SELECT DISTINCT qid, tok FROM tr) b ON a.qid = b.qid),
    sim AS (SELECT p.qid, p.ta, p.tb, list_dot_product(x.v, y.v) AS s
            FROM pairs p JOIN tv x ON x.tok = p.ta JOIN tv y ON y.tok = p.tb),
    bp AS (SELECT qid, ta, max(s) AS m FROM sim GROUP BY ALL),
    br AS (SELECT qid, tb, max(s) AS m FROM sim GROUP BY ALL),
    prec AS (SELECT t.qid, avg(coalesce(bp.m, 0.0)) AS p FROM tp t
             LEFT JOIN bp ON bp.qid = t.qid AND bp.ta = t.tok GROUP BY t.qid),
    rec AS (SELECT t.qid, avg(coalesce(br.m, 0.0)) AS r FROM tr t
            LEFT JOIN br ON br.qid = t.qid AND br.tb = t.tok GROUP BY t.qid),
    pr AS (SELECT q.qid, CASE WHEN p.p IS NULL OR r.r IS NULL THEN 0.0 ELSE p.p END AS p,
                  CASE WHEN p.p IS NULL OR r.r IS NULL THEN 0.0 ELSE r.r END AS r
           FROM predictions q LEFT JOIN prec p ON p.qid = q.qid LEFT JOIN rec r ON r.qid = q.qid)
    SELECT qid, {rd('p')} AS greedy_precision, {rd('r')} AS greedy_recall,
           {rd('CASE WHEN p + r > 0 THEN 2.0 * p * r / (p + r) ELSE 0.0 END')} AS greedy_f1
    FROM pr"""


def rouge_l_sql(rounded: bool = True) -> str:
    """L3 twin: LCS by a recursive CTE over reference tokens; each step builds the next
    DP row as the running maximum of (match ? left-diagonal + 1 : above)."""
    rt = M.rouge_tokens_sql
    lcs = X.with_ctes("predictions").replace("WITH ", "WITH RECURSIVE ", 1) + f""",
    tp AS (SELECT qid, unnest(t) AS tok, generate_subscripts(t, 1) AS j FROM (SELECT qid, {rt('prediction')} AS t FROM predictions)),
    tr AS (SELECT qid, unnest(t) AS tok, generate_subscripts(t, 1) AS i FROM (SELECT qid, {rt('reference')} AS t FROM predictions)),
    rec AS (
      SELECT qid, 0 AS i, j, 0 AS l FROM tp
      UNION ALL
      SELECT qid, i + 1, j, max(cand) OVER (PARTITION BY qid ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
      FROM (SELECT r.qid, r.i, r.j,
                   CASE WHEN b.tok = a.tok THEN coalesce(lag(r.l) OVER (PARTITION BY r.qid ORDER BY r.j), 0) + 1
                        ELSE r.l END AS cand
            FROM rec r JOIN tr b ON b.qid = r.qid AND b.i = r.i + 1 JOIN tp a ON a.qid = r.qid AND a.j = r.j)),
    lens AS (SELECT qid, len({rt('prediction')}) AS lp, len({rt('reference')}) AS lr FROM predictions),
    best AS (SELECT r.qid, r.l FROM rec r JOIN lens n ON n.qid = r.qid AND r.i = n.lr AND r.j = n.lp)
    """
    p = "coalesce(b.l, 0) / greatest(n.lp, 1)"
    r = "coalesce(b.l, 0) / greatest(n.lr, 1)"
    f = f"CASE WHEN ({p}) + ({r}) > 0 THEN 2.0 * ({p}) * ({r}) / (({p}) + ({r})) ELSE 0.0 END"
    out = r6_sql(f) if rounded else f
    return lcs + f"SELECT n.qid, {out} AS rougeL_f1 FROM lens n LEFT JOIN best b ON b.qid = n.qid"


RANK_CTES = dict(S.SEARCH_CTES)
RANK_CTES.update({
    "hits05": (("fused",), """
        SELECT * FROM (SELECT query_id, chunk_id,
                              row_number() OVER (PARTITION BY query_id ORDER BY final_rank DESC, chunk_id) AS rank
                       FROM fused WHERE final_rank > 0.5) WHERE rank <= 20"""),
    "flagged": (("hits05", "chunks"), """
        SELECT h.query_id, h.chunk_id, h.rank, (c.source = qc.source AND h.chunk_id <> h.query_id) AS relevant
        FROM hits05 h JOIN chunks c ON c.chunk_id = h.chunk_id JOIN chunks qc ON qc.chunk_id = h.query_id"""),
    "n_rel": (("chunks", "queries"), """
        SELECT c.chunk_id AS query_id, g.n - 1 AS n_relevant
        FROM chunks c JOIN (SELECT source, count(*) AS n FROM chunks GROUP BY source) g ON g.source = c.source
        WHERE c.chunk_id IN (SELECT query_id FROM queries)"""),
})


def rctes(*names):
    return X.with_ctes(*names, extra=RANK_CTES)


register("bleu", q_bleu, bleu_sql())
register("rouge_n", q_rouge_n, X.with_ctes("predictions") + f"""
    SELECT qid, {r6_sql('rouge1_f1')} AS rouge1_f1, {r6_sql('rouge2_f1')} AS rouge2_f1 FROM ({rouge_sql()})""")
register("rouge_l", q_rouge_l, rouge_l_sql())
_WEIGHT = "(" + " + ".join(f"CAST(u >= {p!r} AS INTEGER)" for p in M._POISSON) + ")"
register("rouge_resampled", q_rouge_resampled, X.with_ctes("predictions") + f"""
    SELECT measure, {r6_sql("m[greatest(1, CAST(ceil(len(m) * 0.025) AS BIGINT))]")} AS low,
           {r6_sql("m[greatest(1, CAST(ceil(len(m) * 0.5) AS BIGINT))]")} AS mid,
           {r6_sql("m[greatest(1, CAST(ceil(len(m) * 0.975) AS BIGINT))]")} AS high
    FROM (SELECT measure, list(mean ORDER BY mean) AS m FROM (
      SELECT measure, r, sum({_WEIGHT} * f) / sum({_WEIGHT}) AS mean FROM (
        SELECT s.*, r, CAST(('0x' || substr(md5(s.qid || ':' || r), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM (
          SELECT a.qid, unnest(['rouge1_f1', 'rouge2_f1', 'rougeL_f1']) AS measure, unnest([a.rouge1_f1, a.rouge2_f1, l.rougeL_f1]) AS f
          FROM ({rouge_sql()}) a JOIN ({rouge_l_sql(False)}) l ON l.qid = a.qid) s, range(1, 201) t(r))
      GROUP BY measure, r HAVING sum({_WEIGHT}) > 0) GROUP BY measure)""")
register("greedy_match_score", q_greedy_match_score, X.with_ctes("predictions") + greedy_sql())
register("recall_at_k", q_recall_at_k, rctes("flagged", "n_rel") + f"""
    SELECT CAST({K_RECALL} AS BIGINT) AS k, {r6_sql('avg(recall)')} AS recall, count(*) AS n_queries FROM (
      SELECT coalesce(g.g, 0) / n.n_relevant AS recall FROM n_rel n
      LEFT JOIN (SELECT query_id, count(*) AS g FROM flagged WHERE relevant AND rank <= {K_RECALL} GROUP BY query_id) g
        ON g.query_id = n.query_id
      WHERE n.n_relevant > 0)""")
register("mrr", q_mrr, rctes("flagged", "n_rel") + f"""
    SELECT {r6_sql('avg(rr)')} AS mrr, count(*) AS n_queries FROM (
      SELECT coalesce(1.0 / f.r, 0.0) AS rr FROM n_rel n
      LEFT JOIN (SELECT query_id, min(rank) AS r FROM flagged WHERE relevant GROUP BY query_id) f
        ON f.query_id = n.query_id
      WHERE n.n_relevant > 0)""")
register("eval_report", q_eval_report, X.with_ctes("predictions") + f"""
    SELECT p.qid, p.question AS query, p.reference AS answer_reference, p.prediction AS answer_prediction,
           {T._lit_sql(C.NO_SOURCES)} AS sources_prediction, g.greedy_precision AS bert_precision,
           g.greedy_recall AS bert_recall, g.greedy_f1 AS bert_f1,
           b.bleu, {r6_sql('m.rouge1_f1')} AS rouge1_f1, {r6_sql('m.rouge2_f1')} AS rouge2_f1, {r6_sql('l.f')} AS rougeL_f1
    FROM predictions p JOIN ({X.with_ctes("predictions") + greedy_sql()}) g ON g.qid = p.qid,
         (SELECT bleu FROM ({bleu_sql()})) b, (SELECT avg(rougeL_f1) AS f FROM ({rouge_l_sql(False)})) l,
         (SELECT avg(rouge1_f1) AS rouge1_f1, avg(rouge2_f1) AS rouge2_f1 FROM ({rouge_sql()})) m""")
