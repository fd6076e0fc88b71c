"""Registered chunking and embedding queries (C, D) and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ragloom import constants as C
from ragloom.functions import text as T
from ragloom.operators import chunking, embedding
from ragloom.plans.common import r6, r6_sql, register
from ragloom.sources import fixtures as X

SEMANTIC_DIM = 256
EMBED_DIM = 64


def _pages(spark, sf):
    return X.pages(spark, sf).select("source", "page_number", "text")


def q_chunk_separator(spark, sf):
    return chunking.chunk_separator(_pages(spark, sf), "\n\n")


def q_chunk_lines(spark, sf):
    return chunking.chunk_separator(_pages(spark, sf), "\n")


def q_chunk_recursive(spark, sf):
    return chunking.chunk_recursive(_pages(spark, sf))


def q_chunk_semantic(spark, sf):
    return chunking.chunk_semantic(_pages(spark, sf), dim=SEMANTIC_DIM)


def q_chunk_semantic_relational(spark, sf):
    return chunking.chunk_semantic_relational(_pages(spark, sf), dim=SEMANTIC_DIM)


def q_chunk_stats(spark, sf):
    return r6(chunking.chunk_stats(chunking.chunk_separator(_pages(spark, sf), "\n")), "avg_len")


def q_embed_hash(spark, sf):
    ch = X.chunks(spark, sf)
    v = embedding.hash_embed(ch, "content", EMBED_DIM, prefix=C.PASSAGE_PREFIX, dtype="double")
    return r6(v.select("chunk_id", F.posexplode("embedding").alias("bucket", "weight")).where("weight > 0").withColumn(
        "bucket", F.col("bucket").cast("long")), "weight")


# ------------------------------------------------------------------ SQL twins

def separator_chunks_sql(sep: str, size: int = C.CHUNK_SIZE, overlap: int = C.CHUNK_OVERLAP) -> str:
    """C1 as a recursive CTE: state (i = next piece, s = first kept piece); the kept
    length is recomputed from prefix sums, the pop loop is "smallest j that stops it"."""
    sl = len(sep)
    sep_sql = T._lit_sql(sep).replace("\n", "' || chr(10) || '")
    tot = f"(CASE WHEN j < r.i THEN p.pre[r.i] - p.pre[j] + {sl} * (r.i - 1 - j) ELSE 0 END)"
    cond = f"({tot} > {overlap} OR ({tot} + p.lens[r.i] + (CASE WHEN j < r.i THEN {sl} ELSE 0 END) > {size} AND {tot} > 0))"
    cur_total = f"(CASE WHEN r.s < r.i THEN p.pre[r.i] - p.pre[r.s] + {sl} * (r.i - 1 - r.s) ELSE 0 END)"
    over = f"({cur_total} + p.lens[r.i] + (CASE WHEN r.s < r.i THEN {sl} ELSE 0 END) > {size})"
    new_s = f"(CASE WHEN {over} AND r.s < r.i THEN list_filter(range(r.s, r.i + 1), lambda j: NOT {cond})[1] ELSE r.s END)"
    emitted = f"(CASE WHEN {over} AND r.s < r.i THEN {T.py_strip_sql(f'array_to_string(p.ps[r.s:r.i - 1], {sep_sql})')} END)"
    return X.with_ctes("pages_nb").replace("WITH ", "WITH RECURSIVE ", 1) + f""",
    pc AS (
      SELECT source, page_number, ps,
             list_transform(ps, lambda x: length(x)) AS lens
      FROM (SELECT source, page_number,
                   list_filter(string_split(text, {sep_sql}), lambda x: x <> '') AS ps FROM pages_nb)),
    p AS (
      SELECT source, page_number, ps, lens,
             list_transform(range(0, len(ps) + 1), lambda j: coalesce(list_sum(lens[1:j]), 0)) AS pre0
      FROM pc),
    p2 AS (SELECT source, page_number, ps, lens, pre0 AS pre, len(ps) AS n FROM p),
    rec AS (
      SELECT source, page_number, 1 AS i, 1 AS s, CAST(NULL AS VARCHAR) AS emitted FROM p2
      UNION ALL
      SELECT r.source, r.page_number, r.i + 1, {new_s}, {emitted}
      FROM rec r JOIN p2 p ON p.source = r.source AND p.page_number = r.page_number
      WHERE r.i <= p.n),
    last AS (
      SELECT r.source, r.page_number, r.i + 1 AS i,
             {T.py_strip_sql(f'array_to_string(p.ps[r.s:p.n], {sep_sql})')} AS emitted
      FROM rec r JOIN p2 p ON p.source = r.source AND p.page_number = r.page_number
      WHERE r.i = p.n + 1),
    allc AS (SELECT source, page_number, i, emitted FROM rec WHERE emitted IS NOT NULL AND emitted <> ''
             UNION ALL SELECT source, page_number, i, emitted FROM last WHERE emitted <> '')
    SELECT source, page_number,
           row_number() OVER (PARTITION BY source, page_number ORDER BY i) - 1 AS chunk_index,
           emitted AS content
    FROM allc"""


def recursive_chunks_sql(size=C.CHUNK_SIZE, overlap=C.CHUNK_OVERLAP, seps=C.RECURSIVE_SEPARATORS) -> str:
    """C2 as recursive CTEs: ``tree`` expands each page (and every piece of ``size``
    characters or more) with the first separator present, separators kept; consecutive
    short siblings form runs; each run is merged like C1 with an empty separator."""
    lit = lambda s: "(" + " || ".join(f"chr({ord(c)})" for c in s) + ")" if s else "''"
    SEPS = "[" + ", ".join(lit(s) for s in seps) + "]"
    N = len(seps)
    tot = "(CASE WHEN j < r.i THEN p.pre[r.i] - p.pre[j] ELSE 0 END)"
    cond = f"({tot} > {overlap} OR ({tot} + p.lens[r.i] > {size} AND {tot} > 0))"
    cur = "(CASE WHEN r.s < r.i THEN p.pre[r.i] - p.pre[r.s] ELSE 0 END)"
    over = f"({cur} + p.lens[r.i] > {size})"
    new_s = f"(CASE WHEN {over} AND r.s < r.i THEN list_filter(range(r.s, r.i + 1), lambda j: NOT {cond})[1] ELSE r.s END)"
    emitted = f"(CASE WHEN {over} AND r.s < r.i THEN {T.py_strip_sql('array_to_string(p.ps[r.s:r.i - 1], ' + chr(39) * 2 + ')')} END)"
    last = T.py_strip_sql("array_to_string(p.ps[r.s:p.n], '')")
    return X.with_ctes("pages_nb").replace("WITH ", "WITH RECURSIVE ", 1) + f""",
    tree AS (
      SELECT source, page_number, CAST([] AS INTEGER[]) AS path, text AS txt, 1 AS k, true AS root FROM pages_nb
      UNION ALL
      SELECT source, page_number, list_append(path, CAST(idx AS INTEGER)), piece, kn, false FROM (
        SELECT source, page_number, path, kn, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS idx FROM (
          SELECT source, page_number, path, z + 1 AS kn,
                 CASE WHEN sp = '' THEN string_split(txt, '')
                      ELSE list_filter(list_transform(string_split(txt, sp),
                             lambda x, i: CASE WHEN i = 1 THEN x ELSE sp || x END), lambda x: x <> '') END AS pieces
          FROM (SELECT source, page_number, path, txt, z, {SEPS}[z] AS sp FROM (
                  SELECT r.*, list_filter(range(r.k, {N} + 1), lambda z: {SEPS}[z] = '' OR contains(r.txt, {SEPS}[z]))[1] AS z
                  FROM tree r WHERE r.root OR (length(r.txt) >= {size} AND r.k <= {N}))))))
    ,kids AS (
      SELECT source, page_number, path[1:len(path) - 1] AS parent, path[len(path)] AS idx, path, txt,
             length(txt) >= {size} AS long
      FROM tree WHERE NOT root)
    ,runs AS (
      SELECT *, sum(CASE WHEN long THEN 1 ELSE 0 END) OVER (PARTITION BY source, page_number, parent ORDER BY idx
                                                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run
      FROM kids)
    ,p2 AS (
      SELECT source, page_number, parent, run, min(path) AS seg, list(txt ORDER BY idx) AS ps,
             list(length(txt) ORDER BY idx) AS lens
      FROM runs WHERE NOT long GROUP BY source, page_number, parent, run)
    ,p AS (SELECT *, list_transform(range(0, len(ps) + 1), lambda j: coalesce(list_sum(lens[1:j]), 0)) AS pre,
                  len(ps) AS n FROM p2)
    ,rec AS (
      SELECT source, page_number, seg, 1 AS i, 1 AS s, CAST(NULL AS VARCHAR) AS emitted FROM p
      UNION ALL
      SELECT r.source, r.page_number, r.seg, r.i + 1, {new_s}, {emitted}
      FROM rec r JOIN p ON p.source = r.source AND p.page_number = r.page_number AND p.seg = r.seg
      WHERE r.i <= p.n)
    ,lastc AS (
      SELECT r.source, r.page_number, r.seg, r.i + 1 AS i, {last} AS emitted
      FROM rec r JOIN p ON p.source = r.source AND p.page_number = r.page_number AND p.seg = r.seg
      WHERE r.i = p.n + 1)
    ,allc AS (SELECT source, page_number, seg, i, emitted FROM rec WHERE emitted IS NOT NULL AND emitted <> ''
              UNION ALL SELECT source, page_number, seg, i, emitted FROM lastc WHERE emitted <> '')
    SELECT source, page_number,
           row_number() OVER (PARTITION BY source, page_number ORDER BY seg, i) - 1 AS chunk_index,
           emitted AS content
    FROM allc"""


def semantic_chunks_sql(dim: int = SEMANTIC_DIM, percentile: float = 0.95) -> str:
    toks = T.tokens_sql("sentence", False)
    bucket = embedding.hash_bucket_sql("tok", dim)
    return X.with_ctes("pages_nb") + f""",
    sent AS (
      SELECT source, page_number, len(ss) AS n_sent, unnest(ss) AS sentence, generate_subscripts(ss, 1) - 1 AS i
      FROM (SELECT source, page_number,
                   string_split(regexp_replace(text, '([.?!]){T.WS}+', '\\1\x01', 'g'), '\x01') AS ss FROM pages_nb)),
    counts AS (
      SELECT source, page_number, i, n_sent, {bucket} AS bucket, count(*)::DOUBLE AS weight
      FROM (SELECT source, page_number, i, n_sent, unnest({toks}) AS tok FROM sent) GROUP BY ALL),
    groups AS (
      SELECT source, page_number, g, bucket, sum(weight) AS w
      FROM (SELECT source, page_number, bucket, weight, n_sent, unnest(range(i - 1, i + 2)) AS g FROM counts)
      WHERE g >= 0 AND g < n_sent GROUP BY ALL),
    norms AS (SELECT source, page_number, g, sqrt(sum(w * w)) AS norm FROM groups GROUP BY ALL),
    dots AS (
      SELECT a.source, a.page_number, a.g, sum(a.w * b.w) AS dot
      FROM groups a JOIN groups b ON a.source = b.source AND a.page_number = b.page_number
        AND b.g = a.g + 1 AND b.bucket = a.bucket GROUP BY ALL),
    dist AS (
      SELECT p.source, p.page_number, p.i AS g,
             1.0 - coalesce(CASE WHEN na.norm > 0 AND nb.norm > 0 THEN coalesce(d.dot, 0.0) / (na.norm * nb.norm) END, 0.0) AS d
      FROM (SELECT source, page_number, i FROM sent WHERE i < n_sent - 1) p
      LEFT JOIN dots d ON d.source = p.source AND d.page_number = p.page_number AND d.g = p.i
      LEFT JOIN norms na ON na.source = p.source AND na.page_number = p.page_number AND na.g = p.i
      LEFT JOIN norms nb ON nb.source = p.source AND nb.page_number = p.page_number AND nb.g = p.i + 1),
    thr AS (SELECT *, quantile_cont(d, {percentile}) OVER (PARTITION BY source, page_number) AS thr FROM dist),
    s2 AS (
      SELECT s.source, s.page_number, s.i, s.sentence, coalesce(CAST(t.d > t.thr AS INTEGER), 0) AS brk
      FROM sent s LEFT JOIN thr t ON t.source = s.source AND t.page_number = s.page_number AND t.g = s.i),
    s3 AS (
      SELECT *, coalesce(sum(brk) OVER (PARTITION BY source, page_number ORDER BY i
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS piece FROM s2)
    SELECT source, page_number, CAST(piece AS BIGINT) AS chunk_index, content FROM (
      SELECT source, page_number, piece, string_agg(sentence, ' ' ORDER BY i) AS content FROM s3 GROUP BY ALL)
    WHERE NOT {T.is_blank_sql('content')}"""


def chunk_stats_sql() -> str:
    return f"""
    SELECT source, count(*) AS n_chunks, min(length(content))::BIGINT AS min_len,
           {r6_sql('avg(length(content))')} AS avg_len, max(length(content))::BIGINT AS max_len
    FROM ({separator_chunks_sql(chr(10))}) GROUP BY source"""


register("chunk_separator", q_chunk_separator, separator_chunks_sql("\n\n"))
register("chunk_lines", q_chunk_lines, separator_chunks_sql("\n"))
register("chunk_recursive", q_chunk_recursive, recursive_chunks_sql())
register("chunk_semantic", q_chunk_semantic, semantic_chunks_sql())
register("chunk_semantic_relational", q_chunk_semantic_relational, semantic_chunks_sql())
register("chunk_stats", q_chunk_stats, chunk_stats_sql())
register("embed_hash", q_embed_hash, X.with_ctes("chunks") + f"""
    SELECT chunk_id, bucket, {r6_sql('weight / sqrt(sum(weight * weight) OVER (PARTITION BY chunk_id))')} AS weight
    FROM (SELECT chunk_id, {embedding.hash_bucket_sql('tok', EMBED_DIM)} AS bucket, count(*)::DOUBLE AS weight
          FROM (SELECT chunk_id, unnest({T.tokens_sql(f"'{C.PASSAGE_PREFIX}' || content", False)}) AS tok FROM chunks)
          GROUP BY ALL)""")
