"""Approximate vector search (G6, re-aimed): an inverted-file (IVF) index.

Index build: unit-normalised vectors are clustered with Spark ML ``KMeans``
(distributed Lloyd iterations); every chunk is assigned to its nearest centroid
(``list_id``). Stored as parquet partitioned by ``list_id``, a probe of some lists
reads only those partitions.

Search: each query probes its ``n_probe`` nearest centroids; chunks of the probed
lists are scanned in place (``mapInPandas``) against only the queries that probe
their list, keeping per-partition top-k candidates as in the exact search; the
final top-k per query is exact over the probed lists.

How many lists to probe: ``probes_for`` measures it, for a wanted recall, on some queries'
exact results. With the lists' ``radii`` the search is exact: a row of a list is no nearer to the query than
the distance to the centroid less the list's radius, so after the first probes only those lists
are read whose bound reaches the k-th score found; ``recall_vs_exact`` reports recall.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom import constants as C
from ragloom.functions.numeric import round_half_up
from ragloom.operators import sizing
from ragloom.operators.lexical import RANK_DIGITS, top_k
from ragloom.operators.vector_search import _MARGIN, _as_matrix, _compact, _query_matrix


FILES_OF_LIST = 4  # at most so many files of a stored list, so a large one isn't one task's
SCORES = 1 << 20  # scores that a task computes at once


def _unit(vec_col: str):
    v = F.col(vec_col)
    n = F.sqrt(F.aggregate(F.transform(v, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, b: a + b))
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n))


def build_ivf(chunks: DataFrame, n_lists: int | None = None, vec_col: str = "embedding", seed: int = 7,
              max_iter: int = 20, broadcast_limit_bytes: int | None = None):
    """Returns ``(index, centers)``: index rows ``(chunk_id, list_id, distance, vec)``, with the distance to the
    centroid, and the centroid matrix."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    unit = chunks.select(F.col("chunk_id").cast("long").alias("chunk_id"), _unit(vec_col).alias("vec")).where(
        F.col("vec").isNotNull())
    unit = sizing.materialize(unit)
    n = unit.count()
    dim = len(unit.first()["vec"]) if n else 0
    most = max(1, sizing.broadcast_limit(unit, broadcast_limit_bytes) // max(1, dim * 8))  # the centroids are broadcast
    if n_lists and n_lists > most:
        raise ValueError(f"{n_lists} lists of width {dim} exceed the broadcast limit")
    n_lists = n_lists or max(1, min(int(math.sqrt(n)), most))
    # a fixed layout (hash partitions, sorted inside) so the seeded k-means|| start is reproducible
    layout = unit.repartition(int(unit.sparkSession.conf.get("spark.sql.shuffle.partitions")), "chunk_id") \
        .sortWithinPartitions("chunk_id")
    km = KMeans(k=n_lists, seed=seed, maxIter=max_iter, featuresCol="features").fit(
        layout.select(array_to_vector("vec").alias("features")))
    centers = np.array([np.asarray(c, dtype=np.float64) for c in km.clusterCenters()])
    bc = chunks.sparkSession.sparkContext.broadcast(centers)

    def assign(batches):
        cm = bc.value
        for pdf in batches:
            x = np.stack([np.asarray(v, dtype=np.float64) for v in pdf["vec"]]) if len(pdf) else np.zeros((0, cm.shape[1]))
            # |x - c|^2 less |x|^2, in blocks of bounded size
            half, step = (cm ** 2).sum(axis=1) / 2, max(1, 4_000_000 // len(cm))
            nearest = [(half - x[a:a + step] @ cm.T).argmin(axis=1) for a in range(0, len(x), step)]
            lists = (np.concatenate(nearest) if nearest else np.zeros(0)).astype(np.int64)
            yield pd.DataFrame({"chunk_id": pdf["chunk_id"].to_numpy(), "list_id": lists.astype(np.int64),
                                "distance": np.sqrt(((x - cm[lists]) ** 2).sum(axis=1)) if len(x) else np.zeros(0), "vec": pdf["vec"]})

    index = unit.mapInPandas(assign, "chunk_id long, list_id long, distance double, vec array<double>")
    return index, centers


def store_index(index: DataFrame) -> DataFrame:
    """Write the index as parquet partitioned by ``list_id`` under the checkpoint folder and
    read it back, so a probe's ``list_id IN (...)`` filter prunes partitions."""
    import uuid

    from ragloom.session import scratch_path

    path = scratch_path(index.sparkSession, f"ivf/{uuid.uuid4().hex}")
    # a list's rows meet in few tasks, so it is few files however many tasks assigned them
    rows = index.repartition(F.col("list_id"), F.pmod(F.xxhash64("chunk_id"), F.lit(FILES_OF_LIST)))
    rows.write.partitionBy("list_id").parquet(path)
    return index.sparkSession.read.parquet(path)


def _probe_scan(bc, k: int, dim: int):
    def fn(batches):
        qids, qm, probes = bc.value  # probes: (queries, lists), true where the list is read
        held, size = [], 0
        kth = np.full(len(qids), -np.inf)  # a query's k-th best score so far: worse rows aren't kept

        def cut():
            cq, cs, cid = _compact(*(np.concatenate(x) for x in zip(*held)), k)  # sorted by query, best first
            begin = np.flatnonzero(np.r_[True, cq[1:] != cq[:-1]])
            full = begin[np.diff(np.r_[begin, len(cq)]) >= k]
            kth[cq[full]] = cs[full + k - 1]
            return cq, cs, cid

        for pdf in batches:
            if len(pdf) == 0 or len(qids) == 0:
                continue
            ok, xm = _as_matrix(pdf["vec"], dim)
            ids = pdf["chunk_id"].to_numpy(dtype=np.int64)[ok]
            lists = pdf["list_id"].to_numpy(dtype=np.int64)[ok]
            for lst in np.unique(lists):
                qsel = np.nonzero(probes[:, lst])[0]
                if len(qsel) == 0:
                    continue
                rows, step = np.flatnonzero(lists == lst), max(1, SCORES // len(qsel))
                for a in range(0, len(rows), step):
                    some = rows[a:a + step]
                    s = (1.0 + xm[some] @ qm[qsel].T) / 2.0
                    r, q = np.nonzero(s >= kth[qsel] - _MARGIN)
                    held.append((qsel[q], s[r, q], ids[some][r]))
                    size += len(r)
                    if size > 2 * k * len(qids) + SCORES:
                        held = [cut()]
                        size = len(held[0][0])
        if size:
            cq, cs, cid = cut()
            yield pd.DataFrame({"query_id": qids[cq], "chunk_id": cid, "score": cs})

    return fn


def radii(index: DataFrame, n_lists: int) -> np.ndarray:
    """The greatest distance of a row to its list's centroid; -1 for an empty list."""
    out = np.full(n_lists, -1.0)
    for r in index.groupBy("list_id").agg(F.max("distance").alias("radius")).collect():  # a row for each list
        out[r["list_id"]] = r["radius"]
    return out


def _to_centers(qm: np.ndarray, centers: np.ndarray) -> np.ndarray:
    d = (qm ** 2).sum(axis=1)[:, None] + (centers ** 2).sum(axis=1)[None, :] - 2.0 * (qm @ centers.T)
    return np.sqrt(np.maximum(d, 0.0))


def _first(away: np.ndarray, n_probe: int) -> np.ndarray:
    """True for the ``n_probe`` lists nearest to each query."""
    out = np.zeros(away.shape, dtype=bool)
    np.put_along_axis(out, np.argsort(away, axis=1, kind="stable")[:, :n_probe], True, axis=1)
    return out


def _read(index: DataFrame, qids, qm, probes: np.ndarray, k: int) -> DataFrame:
    bc = index.sparkSession.sparkContext.broadcast((qids, qm, probes))
    wanted = np.flatnonzero(probes.any(axis=0)).tolist()
    return index.where(F.col("list_id").isin(wanted)).mapInPandas(
        _probe_scan(bc, k, qm.shape[1]), "query_id long, chunk_id long, score double")


def ann_topk(index: DataFrame, centers: np.ndarray, queries: DataFrame, k: int = C.SEMANTIC_CANDIDATES,
             n_probe: int = 4, query_vec: str = "query_vec", radius: np.ndarray | None = None) -> DataFrame:
    """Top ``k`` per query over the ``n_probe`` lists nearest to the query. With ``radius`` (from ``radii``) it
    is the exact top ``k``: lists that may hold a row as good as the k-th one found are read too."""
    dim, n_lists = centers.shape[1], len(centers)
    limit, row_bytes = sizing.broadcast_limit(queries), dim * 8 + 64 + n_lists * 8
    n_blocks = max(1, -(-queries.count() * row_bytes // limit))  # each block of queries fits the limit
    cand = []
    for b in range(n_blocks):
        block = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == b) if n_blocks > 1 else queries
        qids, qm = _query_matrix(block, "query_id", query_vec, dim)
        away = _to_centers(qm, centers) if len(qids) else np.zeros((0, n_lists))
        probes = _first(away, n_probe)
        part = _read(index, qids, qm, probes, k)
        cand.append(part)
        if radius is None:
            continue
        cand[-1] = part = sizing.materialize(part)
        found = top_k(part.select("query_id", "chunk_id", "score"), k, "score").groupBy("query_id").agg(
            F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).toArrow()  # a row for each query of the block
        kth, place = np.full(len(qids), -1.0), {q: i for i, q in enumerate(qids.tolist())}
        for q, n, least in zip(*(found.column(c).to_pylist() for c in ("query_id", "n", "least"))):
            if n >= k:
                kth[place[q]] = least
        # score = 1 - |q - x| ** 2 / 4 for unit vectors
        bound = 1.0 - np.maximum(away - radius[None, :], 0.0) ** 2 / 4.0
        more = (bound >= kth[:, None] - 1e-8) & ~probes & (radius[None, :] >= 0)
        if more.any():
            cand.append(_read(index, qids, qm, more, k))
    cand = reduce(DataFrame.unionByName, cand)
    cand = cand.select("query_id", "chunk_id", round_half_up("score", RANK_DIGITS).alias("rank_semantic"))
    return top_k(cand, k, "rank_semantic")


def probes_for(index: DataFrame, centers: np.ndarray, exact: DataFrame, queries: DataFrame, recall: float = 0.95,
               n_queries: int = 256, query_vec: str = "query_vec") -> int:
    """The least number of probes with which the mean recall over ``n_queries`` queries (those of the least id hash) reaches
    ``recall`` of their ``exact`` results (query_id, chunk_id)."""
    some = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(n_queries)
    qids, qm = _query_matrix(some, "query_id", query_vec, centers.shape[1])
    if not len(qids):
        return len(centers)
    rank = np.argsort(np.argsort(_to_centers(qm, centers), axis=1, kind="stable"), axis=1, kind="stable")
    wanted = exact.select("query_id", "chunk_id").join(F.broadcast(some.select("query_id")), "query_id")
    held = wanted.join(index.select("chunk_id", "list_id"), "chunk_id").groupBy("query_id", "list_id").agg(
        F.count(F.lit(1)).alias("n")).toArrow()  # at most n_queries times the lists
    place, share = {q: i for i, q in enumerate(qids.tolist())}, np.zeros(rank.shape)
    for q, lst, n in zip(*(held.column(c).to_pylist() for c in ("query_id", "list_id", "n"))):
        if q in place:
            share[place[q], rank[place[q], lst]] += n
    share = share[share.sum(axis=1) > 0]
    if not len(share):
        return 1
    mean = (np.cumsum(share, axis=1) / share.sum(axis=1)[:, None]).mean(axis=0)
    return int(np.argmax(mean >= recall - 1e-12)) + 1


def recall_vs_exact(approx: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact top-k found by the approximate top-k, averaged over queries."""
    hit = exact.select("query_id", "chunk_id").join(approx.select("query_id", "chunk_id").withColumn("f", F.lit(1)),
                                                    ["query_id", "chunk_id"], "left")
    per_q = hit.groupBy("query_id").agg((F.count("f") / F.count(F.lit(1))).alias("r"))
    return per_q.agg(F.avg("r").alias("recall"), F.count(F.lit(1)).alias("n_queries"))
