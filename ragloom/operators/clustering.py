"""Intra-document clustering (J): neighbours, cluster ids, centroids, combined vectors.

Within-document k-NN runs on bounded blocks: each document's chunks are hashed into
ceil(n / ``block_rows``) blocks; every (left block, right block) pair of one
document meets in one ``applyInPandas`` group (about 2 x block_rows rows),
computes distances in numpy and emits only each left row's k best. A very large
document therefore spreads over many tasks instead of landing in one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragloom import constants as C
from ragloom.functions import text as T
from ragloom.functions import vectors as V
from ragloom.functions.numeric import round_half_up
from ragloom.operators.sizing import materialize

_MARGIN = 1e-9
AT_ONCE = 1 << 20  # differences of coordinates that a task holds at a time


def _knn_block(k: int, id_col: str, vec_col: str):
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        left = pdf[pdf["side"] == 0]
        right = pdf[pdf["side"] == 1]
        empty = pd.DataFrame({"id": [], "nbr": [], "dist": []}).astype({"id": "int64", "nbr": "int64"})
        if len(left) == 0 or len(right) == 0:
            return empty
        lv = np.stack([np.asarray(v, dtype=np.float64) for v in left[vec_col]])
        rv = np.stack([np.asarray(v, dtype=np.float64) for v in right[vec_col]])
        lid = left[id_col].to_numpy(dtype=np.int64)
        rid = right[id_col].to_numpy(dtype=np.int64)
        step = max(1, AT_ONCE // max(1, rv.shape[0] * rv.shape[1]))
        out_i, out_n, out_d = [], [], []
        for lo in range(0, len(lv), step):
            d = np.sqrt(((lv[lo:lo + step, None, :] - rv[None, :, :]) ** 2).sum(axis=2))
            d[lid[lo:lo + step, None] == rid[None, :]] = np.inf  # a chunk is not its own neighbour
            kk = min(k, d.shape[1])
            kth = np.partition(d, kk - 1, axis=1)[:, kk - 1]
            r, c = np.nonzero((d <= kth[:, None] + _MARGIN) & np.isfinite(d))
            out_i.append(lid[lo + r])
            out_n.append(rid[c])
            out_d.append(d[r, c])
        if not out_i:
            return empty
        return pd.DataFrame({"id": np.concatenate(out_i), "nbr": np.concatenate(out_n), "dist": np.concatenate(out_d)})

    return fn


def knn_within(df: DataFrame, group: str, id_col: str, vec_col: str, k: int, block_rows: int = 1024) -> DataFrame:
    """The ``k`` nearest other rows of the same ``group`` (Euclidean), ties by id:
    ``(id, nbr, dist, rank)``."""
    base = df.select(group, F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")).where(
        F.col("vec").isNotNull())
    sizes = base.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    t = base.join(sizes, group).withColumn("nb", F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(block_rows))))
    t = t.withColumn("blk", F.pmod(F.xxhash64("id"), F.col("nb")))
    every = F.explode(F.sequence(F.lit(0).cast("long"), (F.col("nb") - 1).cast("long")))
    left = t.select(group, "id", "vec", F.col("blk").alias("bl"), every.alias("br"), F.lit(0).alias("side"))
    right = t.select(group, "id", "vec", every.alias("bl"), F.col("blk").alias("br"), F.lit(1).alias("side"))
    cand = left.unionByName(right).groupBy(group, "bl", "br").applyInPandas(
        _knn_block(k, "id", "vec"), "id long, nbr long, dist double")
    w = Window.partitionBy("id").orderBy(round_half_up("dist", 9), F.col("nbr"))
    return cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def core_distance(df: DataFrame, group: str = "source", id_col: str = "chunk_id", vec_col: str = "embedding",
                  k: int = 2) -> DataFrame:
    """Distance to the k-th nearest other chunk of the same document (HDBSCAN core distance)."""
    nn = knn_within(df, group, id_col, vec_col, k)
    return nn.where(F.col("rank") == k).select(F.col("id").alias(id_col), F.col("dist").alias("core_distance"))


def mutual_reachability(df: DataFrame, group: str = "source", id_col: str = "chunk_id", vec_col: str = "embedding",
                        k: int = 2) -> DataFrame:
    """``(chunk_id, neighbour, rank, distance)``: each row's ``k`` nearest other rows of its document with
    ``max(core, neighbour's core, distance)``, the core being the distance to the k-th nearest."""
    near = materialize(knn_within(df, group, id_col, vec_col, k))
    core = near.where(F.col("rank") == k).select("id", F.col("dist").alias("core"))
    other = core.select(F.col("id").alias("nbr"), F.col("core").alias("core_b"))
    return near.join(core, "id").join(other, "nbr").select(
        F.col("id").alias(id_col), F.col("nbr").alias("neighbour"), "rank", F.greatest("dist", "core", "core_b").alias("distance"))


def apply_cluster_ids(chunks: DataFrame, labels: DataFrame, min_vectors: int = 2) -> DataFrame:
    """E4 + J3-J5: ``cluster_id = hash_value || '_' || label`` for the chunks of every
    document that has at least ``min_vectors`` vectors and some non-noise label;
    other chunks keep their id (``'-1'`` by default)."""
    base = chunks if "cluster_id" in chunks.columns else chunks.withColumn("cluster_id", F.lit(C.DEFAULT_CLUSTER_ID))
    lab = base.select("chunk_id", "source", "hash_value").join(labels.select("chunk_id", "label"), "chunk_id")
    n_vec = base.where(F.col("embedding").isNotNull()).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    best = lab.groupBy("source").agg(F.max("label").alias("top"))
    ok = n_vec.join(best, "source").where((F.col("n") >= min_vectors) & (F.col("top") >= 0)).select("source")
    new = lab.join(ok, "source", "left_semi").select(
        "chunk_id", F.concat_ws("_", F.col("hash_value"), F.col("label").cast("string")).alias("new_id"))
    return base.join(new, "chunk_id", "left").withColumn(
        "cluster_id", F.coalesce(F.col("new_id"), F.col("cluster_id"), F.lit(C.DEFAULT_CLUSTER_ID))).drop("new_id")


def in_cluster(cluster_id) -> F.Column:
    """A real cluster: second part is not '-1', and not the bare default id."""
    c = F.col(cluster_id) if isinstance(cluster_id, str) else cluster_id
    return (F.split_part(c, F.lit("_"), F.lit(2)) != F.lit("-1")) & (c != F.lit(C.DEFAULT_CLUSTER_ID))


def centroid_table(chunks: DataFrame) -> DataFrame:
    """Mean vector per (source, cluster_id) over real clusters: ``(source, cluster_id, idx, value)``."""
    members = chunks.where(in_cluster("cluster_id") & F.col("embedding").isNotNull())
    mean = _mean_vectors(members)
    return mean.select("source", "cluster_id", F.posexplode("mean").alias("idx", "value"))


def _mean_vectors(members: DataFrame) -> DataFrame:
    """One vector per (source, cluster_id); vectors are summed map-side, never taken apart."""
    x = members.select("source", "cluster_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("x"))
    return x.groupBy("source", "cluster_id").agg(vector_to_array(Summarizer.mean(F.col("x"))).alias("mean"))


def cluster_centroids(chunks: DataFrame) -> DataFrame:
    """Every member gets its cluster's centroid as ``cluster_embedding`` (ARRAY<DOUBLE>)."""
    members = chunks.where(in_cluster("cluster_id") & F.col("embedding").isNotNull())
    cent = _mean_vectors(members).withColumnRenamed("mean", "cluster_embedding")
    return chunks.join(cent, ["source", "cluster_id"], "left")


def combined_embedding(chunks: DataFrame, weights: tuple[float, float] = C.CENTROID_WEIGHTS) -> DataFrame:
    """``0.7 * embedding + 0.3 * centroid``, or the embedding alone without a centroid."""
    wa, wb = weights
    e = F.col("embedding")
    comb = F.when(e.isNull(), F.lit(None)).when(F.col("cluster_embedding").isNull(), F.transform(e, lambda x: x.cast("double"))) \
        .otherwise(V.weighted_sum("embedding", "cluster_embedding", wa, wb))
    return chunks.withColumn("combined_embedding", comb)


def clustered_chunks(chunks: DataFrame, labels: DataFrame) -> DataFrame:
    """J5-J8 in one plan: ids, centroids, combined vectors."""
    return combined_embedding(cluster_centroids(apply_cluster_ids(chunks, labels)))


def label_from_column(chunks: DataFrame, col: str = "label", noise_value: int = 0) -> DataFrame:
    """Labels given with the data (fixture): ``noise_value`` becomes the noise label -1; chunks
    without one (they have no vector) are left out."""
    return chunks.where(F.col(col).isNotNull()).select("chunk_id", F.when(F.col(col) == noise_value, F.lit(C.NOISE_LABEL))
                         .otherwise(F.col(col)).alias("label"))


def with_hash(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("hash_value", T.file_hash("source"))
