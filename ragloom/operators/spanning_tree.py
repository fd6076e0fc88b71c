"""Minimum spanning trees over mutual reachability distances inside documents.

Equal vectors of a document are one point with a weight. Core distances and tree edges come from
distances computed block against block: a document's points are hashed into blocks of about
``block_rows``, and each pair of blocks meets in one ``applyInPandas`` group, so no document gathers
in one task. A document that is one block gets its tree from that block's task. For a larger one the tree
grows in Boruvka rounds: every component finds its least edge to another one (least by block pair,
then by aggregation), and the components that these edges connect are contracted by pointer jumping on written
tables. Edges are ordered by (distance, ids), so no cycle of more than two components can arise.
Each round at least halves the components of a document.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragloom.operators import sizing

BLOCK_ROWS = 2048
_EDGE = "a long, b long, distance double"


def points(df: DataFrame, group: str, id_col: str, vec_col: str) -> tuple[DataFrame, DataFrame]:
    """``(group, id, weight, vec)``: a row for each distinct vector of a document, under its least id; and
    ``(group, id, point)`` for every row with a vector."""
    base = df.where(F.col(vec_col).isNotNull()).select(
        F.col(group).alias("group"), F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    found = sizing.materialize(base.groupBy("group", "vec").agg(F.min("id").alias("point"), F.count(F.lit(1)).alias("weight")))
    same = base["group"].eqNullSafe(found["group"]) & (base["vec"] == found["vec"])
    members = base.join(found, same).select(base["group"], base["id"], "point")
    return found.select("group", F.col("point").alias("id"), "weight", "vec"), members


def _met(rows: DataFrame, block_rows: int) -> DataFrame:
    """Every row once for each pair of blocks ``x <= y`` of its document that it takes part in."""
    sizes = rows.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    t = rows.join(sizes, rows["group"].eqNullSafe(sizes["group"])).select(
        rows["*"], F.ceil(F.col("n") / F.lit(block_rows)).alias("blocks"))
    t = t.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    low = t.select(*rows.columns, F.col("block").alias("x"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("y"), F.lit(0).alias("side"))
    high = t.where("block > 0").select(*rows.columns, F.explode(F.sequence(F.lit(0).cast("long"), F.col("block") - 1)).alias("x"),
                                       F.col("block").alias("y"), F.lit(1).alias("side"))
    return low.unionByName(high)


def _sides(pdf: pd.DataFrame):
    low, high = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
    one = bool(pdf["x"].iloc[0] == pdf["y"].iloc[0])
    return low, low if one else high, one


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of ``a`` to all of ``b``; near ones from the differences themselves."""
    sa, sb = (a ** 2).sum(axis=1), (b ** 2).sum(axis=1)
    d = sa[:, None] + sb[None, :] - 2.0 * (a @ b.T)
    i, j = np.nonzero(d < 1e-6 * (sa[:, None] + sb[None, :]))
    for at in range(0, len(i), 65536):
        p, q = i[at:at + 65536], j[at:at + 65536]
        d[p, q] = ((a[p] - b[q]) ** 2).sum(axis=1)
    return np.sqrt(np.maximum(d, 0.0))


def _vectors(pdf: pd.DataFrame) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in pdf["vec"]])


def _nearest(k: int):
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        low, high, one = _sides(pdf)
        out = []
        if len(low) and len(high):
            d = distances(_vectors(low), _vectors(high))
            if one:
                np.fill_diagonal(d, np.inf)
            for rows, others, m in ((low, high, d),) if one else ((low, high, d), (high, low, d.T)):
                kk = min(k, m.shape[1])
                at = np.argpartition(m, kk - 1, axis=1)[:, :kk]
                out.append(pd.DataFrame({"id": np.repeat(rows["id"].to_numpy(), kk), "distance": np.take_along_axis(m, at, 1).ravel(),
                                         "weight": others["weight"].to_numpy()[at].ravel()}))
        out = pd.concat(out) if out else pd.DataFrame({"id": [], "distance": [], "weight": []})
        return out[np.isfinite(out["distance"])].astype({"id": "int64", "weight": "int64"})

    return fn


def core_distances(pts: DataFrame, core_k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``pts`` with ``core``: the distance to the ``core_k``-th nearest other row of the document, copies counted
    (the farthest, if it has fewer)."""
    near = _met(pts, block_rows).groupBy("group", "x", "y").applyInPandas(_nearest(core_k), "id long, distance double, weight long")
    order = Window.partitionBy("id").orderBy("distance", "weight")
    near = near.withColumn("seen", F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    held = near.withColumnRenamed("weight", "w").join(pts.select("id", "weight"), "id")
    need = F.lit(core_k) - (F.col("weight") - 1)
    core = held.groupBy("id").agg(F.min(F.when(F.col("seen") >= need, F.col("distance"))).alias("core"), F.max("distance").alias("most"))
    return pts.join(core, "id", "left").withColumn(
        "core", F.when(need <= 0, F.lit(0.0)).otherwise(F.coalesce("core", "most", F.lit(0.0)))).drop("most")


def _least(pdf: pd.DataFrame) -> pd.DataFrame:
    """The least edge from each component on either side to another one."""
    low, high, one = _sides(pdf)
    out = []
    if len(low) and len(high):
        d = np.maximum(distances(_vectors(low), _vectors(high)), np.maximum(low["core"].to_numpy()[:, None], high["core"].to_numpy()[None, :]))
        part, other = low["part"].to_numpy(), high["part"].to_numpy()
        d[part[:, None] == other[None, :]] = np.inf
        for m, rows, others in ((d, low, high),) if one else ((d, low, high), (d.T, high, low)):
            mine, theirs = rows["part"].to_numpy(), others["part"].to_numpy()
            names, at = np.unique(mine, return_inverse=True)
            least = np.full(len(names), np.inf)
            np.minimum.at(least, at, m.min(axis=1))
            i, j = np.nonzero((m == least[at][:, None]) & np.isfinite(m))
            p, q = rows["id"].to_numpy()[i], others["id"].to_numpy()[j]
            found = pd.DataFrame({"part": mine[i], "distance": m[i, j], "a": np.minimum(p, q), "b": np.maximum(p, q), "other": theirs[j]})
            out.append(found.sort_values(["part", "a", "b"]).drop_duplicates("part"))
    return pd.concat(out) if out else pd.DataFrame({"part": [], "distance": [], "a": [], "b": [], "other": []}).astype(
        {"part": "int64", "a": "int64", "b": "int64", "other": "int64"})


def _roots(least: DataFrame) -> DataFrame:
    """``(part, root)``: the components that their least edges connect get one name, by pointer jumping."""
    p = least.select("part", F.col("edge.other").alias("root"))
    q = p.select(F.col("part").alias("root"), F.col("root").alias("next"))
    p = p.join(q, "root").select("part", F.when((F.col("next") == F.col("part")) & (F.col("part") < F.col("root")), F.col("part"))
                                 .otherwise(F.col("root")).alias("root"))
    while True:
        p = sizing.materialize(p)
        q = p.select(F.col("part").alias("root"), F.col("root").alias("next"))
        jumped = p.join(q, "root").select("part", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved"))
        jumped = sizing.materialize(jumped)
        if jumped.where("moved").isEmpty():
            return p
        p = jumped.drop("moved")


def _grown(pts: DataFrame, core_k: int, block_rows: int):
    """Edges of the documents that are more than one block, and their points with cores."""
    cored = sizing.materialize(core_distances(pts, core_k, block_rows))
    rows, edges = cored.withColumn("part", F.col("id")), []
    while True:
        least = _met(rows.select("group", "id", "vec", "core", "part"), block_rows).groupBy("group", "x", "y").applyInPandas(
            _least, "part long, distance double, a long, b long, other long")
        least = sizing.materialize(least.groupBy("part").agg(F.min(F.struct("distance", "a", "b", "other")).alias("edge")))
        if least.isEmpty():
            break
        edges.append(least.select("edge.a", "edge.b", "edge.distance").distinct())
        rows = sizing.materialize(rows.join(_roots(least), "part", "left").withColumn("part", F.coalesce("root", "part")).drop("root"))
    return edges, cored


def _prim(core_k: int):
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        ids, weight = pdf["id"].to_numpy(), pdf["weight"].to_numpy()
        x = _vectors(pdf)
        n = len(ids)
        core = np.zeros(n)
        for i in range(n):
            d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
            d[i] = np.inf
            near = np.argsort(d, kind="stable")[:core_k]
            near = near[np.isfinite(d[near])]
            need = core_k - (weight[i] - 1)
            if need > 0 and len(near):
                core[i] = d[near[min(int(np.searchsorted(np.cumsum(weight[near]), need)), len(near) - 1)]]
        best, frm, open_ = np.full(n, np.inf), np.zeros(n, np.int64), np.ones(n, bool)
        out, cur = [(int(ids[i]), int(ids[i]), float(core[i])) for i in range(n)], 0
        open_[0] = False
        for _ in range(n - 1):
            m = np.maximum(np.sqrt(((x - x[cur]) ** 2).sum(axis=1)), np.maximum(core, core[cur]))
            closer = open_ & (m < best)
            best[closer], frm[closer] = m[closer], cur
            nxt = int(np.argmin(np.where(open_, best, np.inf)))
            out.append((*sorted((int(ids[frm[nxt]]), int(ids[nxt]))), float(best[nxt])))
            open_[nxt], cur = False, nxt
        return pd.DataFrame(out, columns=["a", "b", "distance"])

    return fn


def spanning_tree(df: DataFrame, group: str = "source", id_col: str = "chunk_id", vec_col: str = "embedding", core_k: int = 2,
                  block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(group, a, b, distance)``: the n - 1 edges of each document's minimum spanning tree over mutual
    reachability distances ``max(core_a, core_b, d(a, b))``, copies of a vector joined to the one of the least id.
    Rows without a vector take no part; a document of one vector has no edge. Ids must be unique."""
    pts, members = points(df, group, id_col, vec_col)
    members = sizing.materialize(members)
    sizes = pts.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    pts = pts.join(sizes, pts["group"].eqNullSafe(sizes["group"])).select(pts["*"], "n")
    large = sizing.materialize(pts.where(F.col("n") > block_rows).drop("n"))
    small = pts.where(F.col("n") <= block_rows).groupBy("group").applyInPandas(_prim(core_k), _EDGE)
    small = sizing.materialize(small)  # an edge from a point to itself has its core distance
    parts, cores = [small.where("a <> b")], small.where("a = b").select(F.col("a").alias("point"), F.col("distance").alias("core"))
    if not large.isEmpty():
        edges, cored = _grown(large, core_k, block_rows)
        parts += edges
        cores = cores.unionByName(cored.select(F.col("id").alias("point"), "core"))
    copies = members.where("id <> point").join(cores, "point").select(F.col("point").alias("a"), F.col("id").alias("b"), F.col("core").alias("distance"))
    edges = reduce(DataFrame.unionByName, [*parts, copies])
    return edges.join(members.select(F.col("id").alias("a"), F.col("group").alias(group)), "a").select(group, "a", "b", "distance")
