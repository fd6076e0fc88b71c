"""Registered clustering queries (J, G4) and their DuckDB twins.

Cluster labels are the ones given with the vectors (``embeddings.label``, 0 read as
noise), because the fixture vectors carry no cluster geometry to discover.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ragloom import constants as C
from ragloom.functions import text as T
from ragloom.functions.numeric import round_half_up_sql as rhu_sql
from ragloom.operators import clustering as K
from ragloom.operators import hdbscan, ingest
from ragloom.operators import rerank, sizing, spanning_tree, vector_search
from ragloom.plans import search as S
from ragloom.plans.common import r6, r6_sql, register
from ragloom.session import scratch_path
from ragloom.sources import fixtures as X


def _clustered(spark, sf):
    ch = K.with_hash(X.chunks(spark, sf))
    return K.clustered_chunks(ch, K.label_from_column(ch))


def q_apply_cluster_ids(spark, sf):
    ch = K.with_hash(X.chunks(spark, sf))
    return K.apply_cluster_ids(ch, K.label_from_column(ch)).select("chunk_id", "cluster_id")


def q_cluster_centroids(spark, sf):
    ch = K.with_hash(X.chunks(spark, sf))
    ids = K.apply_cluster_ids(ch, K.label_from_column(ch))
    return r6(K.centroid_table(ids).select("source", "cluster_id", F.col("idx").cast("long").alias("idx"), "value"),
              "value")


def q_combined_embedding(spark, sf):
    c = _clustered(spark, sf)
    x = c.select("chunk_id", F.posexplode("combined_embedding").alias("idx", "value"))
    return r6(x.select("chunk_id", F.col("idx").cast("long").alias("idx"), "value"), "value")


def q_clustered_table(spark, sf):
    """Written, and read again."""
    path = scratch_path(spark, f"clustered/{uuid.uuid4().hex}")
    ingest.write_clustered(_clustered(spark, sf), path, "recursive")
    t = spark.read.schema(ingest.CLUSTERED_SCHEMA).parquet(path)
    n = lambda c: F.coalesce(F.size(c).cast("long"), F.lit(0).cast("long"))
    return t.select("chunk_id", "strategy", "cluster_id", F.when(F.col("cluster_embedding").isNull(), 0).otherwise(n("cluster_embedding")).alias("n_cluster"),
                    F.when(F.col("combined_embedding").isNull(), 0).otherwise(n("combined_embedding")).alias("n_combined"))


def _cluster_hits(spark, sf):
    ch = sizing.materialize(X.chunks(spark, sf))
    named = ch.withColumn("text_key", F.xxhash64("content"))  # texts don't go through the joins of the clusters
    c = sizing.materialize(K.clustered_chunks(K.with_hash(named.drop("content")), K.label_from_column(ch))
                           .select("chunk_id", "text_key", "combined_embedding"))
    q = sizing.materialize(X.search_queries(spark, sf, ch))
    dim = vector_search.vector_width(q, "query_vec")
    top = vector_search.semantic_topk(c, q, C.CLUSTER_CANDIDATES, dim=dim, chunk_vec="combined_embedding")
    texts = named.select("chunk_id", "text_key", "content").dropDuplicates(["chunk_id", "text_key"])
    return top, c, q, texts


def q_cluster_topk(spark, sf):
    top, _, _, _ = _cluster_hits(spark, sf)
    return r6(top, "rank_semantic")


def q_cluster_search(spark, sf):
    top, c, q, texts = _cluster_hits(spark, sf)
    hits = top.join(c.select("chunk_id", "text_key"), "chunk_id").join(texts, ["chunk_id", "text_key"]).drop("text_key")
    rr = rerank.rerank(hits, q)
    return r6(rr.select("query_id", "rerank", "chunk_id", "score", "rank"), "score")


def q_hdbscan_labels(spark, sf):
    return hdbscan.hdbscan_labels(X.chunks(spark, sf))


def q_core_distance(spark, sf):
    return r6(K.core_distance(X.chunks(spark, sf)), "core_distance")


def q_mutual_reachability(spark, sf):
    return r6(K.mutual_reachability(X.chunks(spark, sf)), "distance")


def q_spanning_tree(spark, sf):
    """Edges and length of each document's tree."""
    tree = spanning_tree.spanning_tree(X.chunks(spark, sf))
    return r6(tree.groupBy("source").agg(F.count(F.lit(1)).alias("n_edges"), F.sum("distance").alias("length"),
                                         F.max("distance").alias("longest")), "length", "longest")


# ------------------------------------------------------------------ SQL twins

CLUSTER_CTES = dict(S.SEARCH_CTES)
CLUSTER_CTES.update({
    "cl_base": (("chunks",), f"""
        SELECT chunk_id, source, content, embedding, {T.file_hash_sql('source')} AS hash_value,
               CASE WHEN label = 0 THEN -1 ELSE label END AS label FROM chunks"""),
    "cl_ids": (("cl_base",), """
        SELECT b.*, coalesce(CASE WHEN b.source IN (
                   SELECT source FROM cl_base GROUP BY source
                   HAVING count(*) FILTER (WHERE embedding IS NOT NULL) >= 2 AND max(label) >= 0)
                 THEN b.hash_value || '_' || CAST(b.label AS VARCHAR) END, '-1') AS cluster_id
        FROM cl_base b"""),
    "cent": (("cl_ids",), """
        SELECT source, cluster_id, idx, avg(x) AS value FROM (
          SELECT source, cluster_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS idx
          FROM cl_ids WHERE split_part(cluster_id, '_', 2) <> '-1' AND cluster_id <> '-1' AND embedding IS NOT NULL)
        GROUP BY ALL"""),
    "comb": (("cl_ids", "cent"), """
        SELECT i.chunk_id, i.content,
               CASE WHEN i.embedding IS NULL THEN NULL WHEN c.cvec IS NULL THEN i.embedding
                    ELSE list_transform(range(1, len(i.embedding) + 1), lambda k: i.embedding[k] * 0.7 + c.cvec[k] * 0.3)
               END AS combined
        FROM cl_ids i LEFT JOIN (SELECT source, cluster_id, list(value ORDER BY idx) AS cvec FROM cent GROUP BY ALL) c
          ON c.source = i.source AND c.cluster_id = i.cluster_id WHERE i.embedding IS NOT NULL"""),
    "ctop": (("comb", "queries"), f"""
        SELECT * FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank_semantic DESC, chunk_id) AS rank FROM (
            SELECT q.query_id, c.chunk_id, c.content,
                   {rhu_sql("(1.0 + list_cosine_similarity(c.combined, q.query_vec)) / 2.0", 9)} AS rank_semantic
            FROM queries q JOIN comb c ON len(c.combined) = len(q.query_vec)
            WHERE list_dot_product(c.combined, c.combined) > 0))
        WHERE rank <= {C.CLUSTER_CANDIDATES}"""),
})


def ctes(*names):
    return X.with_ctes(*names, extra=CLUSTER_CTES)


_OV = rerank.token_overlap_sql("q.query_text", "t.content")
register("apply_cluster_ids", q_apply_cluster_ids, ctes("cl_ids") + "SELECT chunk_id, cluster_id FROM cl_ids")
register("clustered_table", q_clustered_table, ctes("cl_ids", "cent", "comb") + """
    SELECT i.chunk_id, 'recursive' AS strategy, i.cluster_id, coalesce(c.n, 0) AS n_cluster, coalesce(len(b.combined), 0) AS n_combined
    FROM cl_ids i LEFT JOIN (SELECT source, cluster_id, count(*) AS n FROM cent GROUP BY ALL) c
      ON c.source = i.source AND c.cluster_id = i.cluster_id
    LEFT JOIN comb b ON b.chunk_id = i.chunk_id""")
register("cluster_centroids", q_cluster_centroids, ctes("cent") +
         f"SELECT source, cluster_id, CAST(idx AS BIGINT) AS idx, {r6_sql('value')} AS value FROM cent")
register("combined_embedding", q_combined_embedding, ctes("comb") + f"""
    SELECT chunk_id, CAST(generate_subscripts(combined, 1) - 1 AS BIGINT) AS idx, {r6_sql('unnest(combined)')} AS value
    FROM comb""")
register("cluster_topk", q_cluster_topk, ctes("ctop") +
         f"SELECT query_id, chunk_id, {r6_sql('rank_semantic')} AS rank_semantic, rank FROM ctop")
register("cluster_search", q_cluster_search, ctes("ctop") + f"""
    SELECT query_id, rerank, chunk_id, {r6_sql('score')} AS score, rank FROM (
      SELECT t.query_id, t.chunk_id, t.rank, {_OV} AS score,
             row_number() OVER (PARTITION BY t.query_id ORDER BY {_OV} DESC NULLS LAST, t.rank) AS rerank
      FROM ctop t JOIN queries q ON q.query_id = t.query_id)
    WHERE rerank <= {C.RERANK_TOP}""")
register("core_distance", q_core_distance, X.with_ctes("chunks") + f"""
    SELECT chunk_id, {r6_sql('d')} AS core_distance FROM (
      SELECT a.chunk_id, list_distance(a.embedding, b.embedding) AS d,
             row_number() OVER (PARTITION BY a.chunk_id
                                ORDER BY {rhu_sql('list_distance(a.embedding, b.embedding)', 9)}, b.chunk_id) AS r
      FROM chunks a JOIN chunks b ON a.source = b.source AND a.chunk_id <> b.chunk_id
      WHERE a.embedding IS NOT NULL AND b.embedding IS NOT NULL)
    WHERE r = 2""")
_NEAR = f"""
    SELECT *, row_number() OVER (PARTITION BY a ORDER BY {rhu_sql('d', 9)}, b) AS r FROM (
      SELECT x.chunk_id AS a, y.chunk_id AS b, x.source, list_distance(x.embedding, y.embedding) AS d
      FROM chunks x JOIN chunks y ON x.source = y.source AND x.chunk_id <> y.chunk_id
      WHERE x.embedding IS NOT NULL AND y.embedding IS NOT NULL)"""
register("mutual_reachability", q_mutual_reachability, X.with_ctes("chunks") + f"""
    SELECT n.a AS chunk_id, n.b AS neighbour, CAST(n.r AS INTEGER) AS rank, {r6_sql('greatest(n.d, c.d, e.d)')} AS distance
    FROM ({_NEAR}) n JOIN ({_NEAR}) c ON c.a = n.a AND c.r = 2 JOIN ({_NEAR}) e ON e.a = n.b AND e.r = 2 WHERE n.r <= 2""")
register("spanning_tree", q_spanning_tree, None)
register("hdbscan_labels", q_hdbscan_labels, None)
