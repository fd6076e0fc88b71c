"""Clustering: HDBSCAN on constructed blobs, cluster ids and skip rules, k-NN blocks."""

import numpy as np
from pyspark.sql import functions as F

from ragloom.operators import clustering as K
from ragloom.operators import hdbscan
from ragloom.operators.spanning_tree import spanning_tree


def plain_tree(x, core_k=2):
    """Prim over all pairs: edges by position."""
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))
    away = d + np.where(np.eye(len(x), dtype=bool), np.inf, 0)
    core = np.sort(away, axis=1)[:, min(core_k, len(x) - 1) - 1]
    m = np.maximum(d, np.maximum(core[:, None], core[None, :]))
    inside, edges = [0], []
    while len(inside) < len(x):
        out = [i for i in range(len(x)) if i not in inside]
        w, a, b = min((m[a, b], a, b) for a in inside for b in out)
        inside.append(b)
        edges.append((a, b, w))
    return edges


def plain_labels(x, min_cluster_size=2, core_k=2):
    return hdbscan.tree_labels(len(x), plain_tree(x, core_k), min_cluster_size)


def test_hdbscan_blobs_and_outlier():
    rng = np.random.default_rng(0)
    a = rng.normal(0, 0.05, size=(6, 2))
    b = rng.normal(5, 0.05, size=(5, 2))
    x = np.vstack([a, b, [[20.0, -20.0]]])
    lab = plain_labels(x)
    assert lab[-1] == -1
    assert len(set(lab[:6])) == 1 and len(set(lab[6:11])) == 1 and lab[0] != lab[6]
    assert lab[0] >= 0 and lab[6] >= 0


def test_hdbscan_single_group_is_noise():
    x = np.random.default_rng(1).normal(0, 0.01, size=(5, 3))
    assert set(plain_labels(x)) == {-1}


def test_hdbscan_labels_job(spark):
    rng = np.random.default_rng(2)
    rows = []
    for doc in range(3):
        pts = np.vstack([rng.normal(0, 0.05, (4, 3)), rng.normal(3, 0.05, (4, 3))])
        rows += [(f"d{doc}", doc * 100 + i, list(map(float, p))) for i, p in enumerate(pts)]
    rows.append(("lonely", 999, [0.0, 0.0, 0.0]))
    df = spark.createDataFrame(rows, "source string, chunk_id long, embedding array<double>")
    out = hdbscan.hdbscan_labels(df).collect()
    assert len(out) == 24  # the one-vector document is skipped
    by_doc = {}
    for r in out:
        by_doc.setdefault(r.chunk_id // 100, set()).add(r.label)
    assert all(len(v) == 2 and -1 not in v for v in by_doc.values())


def test_cluster_ids_skip_rules(spark):
    rows = [(1, "a", "ha", [1.0, 0.0], 0), (2, "a", "ha", [0.0, 1.0], 1), (3, "b", "hb", [1.0, 1.0], 0),
            (4, "c", "hc", [1.0, 0.0], -1), (5, "c", "hc", [0.0, 1.0], -1)]
    ch = spark.createDataFrame(rows, "chunk_id long, source string, hash_value string, embedding array<double>, label int")
    ids = {r.chunk_id: r.cluster_id for r in K.apply_cluster_ids(ch, ch.select("chunk_id", "label")).collect()}
    assert ids == {1: "ha_0", 2: "ha_1", 3: "-1", 4: "-1", 5: "-1"}
    cent = K.cluster_centroids(K.apply_cluster_ids(ch, ch.select("chunk_id", "label")))
    comb = {r.chunk_id: r.combined_embedding for r in K.combined_embedding(cent).collect()}
    assert comb[1] == [1.0, 0.0] and comb[4] == [1.0, 0.0]


def test_knn_blocks_match_single_block(spark):
    rng = np.random.default_rng(5)
    rows = [("s", i, list(map(float, rng.normal(size=4)))) for i in range(60)]
    df = spark.createDataFrame(rows, "source string, chunk_id long, embedding array<double>")
    one = {(r.id, r.rank): r.nbr for r in K.knn_within(df, "source", "chunk_id", "embedding", 3).collect()}
    many = {(r.id, r.rank): r.nbr
            for r in K.knn_within(df, "source", "chunk_id", "embedding", 3, block_rows=7).collect()}
    assert one == many and len(one) == 180


def test_hdbscan_many_nested_groups():
    """A long chain of nested clusters needs no recursion, and equal points are one cluster each."""
    x = np.repeat(np.cumsum(1.0 + np.arange(1100) / 1100.0), 3)[:, None]
    chain = [(i, i + 1, float(x[i + 1, 0] - x[i, 0])) for i in range(len(x) - 1)]
    labels = hdbscan.tree_labels(len(x), chain, 2)
    groups = labels.reshape(1100, 3)
    assert (groups == groups[:, :1]).all() and (groups >= 0).all() and len(set(groups[:, 0])) == 1100


def test_spanning_tree_equals_prim_in_one_block_and_in_many(spark):
    rng = np.random.default_rng(8)
    rows, at = [], {}
    for doc, n in (("a", 60), ("b", 37), ("c", 2), ("d", 1), (None, 9), ("e", 30)):
        x = rng.normal(size=(n, 3)) + 6.0 * rng.integers(0, 3, size=(n, 1))
        if doc == "e":
            x[10:] = x[rng.integers(0, 10, 20)]  # copies, up to several of one vector
        at[doc] = (len(rows), x)
        rows += [(doc, len(rows) + i, list(map(float, v))) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows + [("a", 5000, None)], "source string, chunk_id long, embedding array<double>")
    trees = []
    for block_rows in (2048, 7):
        got = {}
        for r in spanning_tree(df, block_rows=block_rows).collect():
            got.setdefault(r.source, []).append((r.a, r.b, r.distance))
        assert "d" not in got
        for doc, (first, x) in at.items():
            want = sorted(w for *_, w in plain_tree(x)) if len(x) > 1 else []
            edges = got.get(doc, [])
            assert np.allclose(sorted(w for *_, w in edges), want)
            parent = {first + i: first + i for i in range(len(x))}
            for a, b, _ in edges:  # no cycle: every edge connects two parts
                while parent[a] != a:
                    a = parent[a]
                while parent[b] != b:
                    b = parent[b]
                assert a != b
                parent[a] = b
        trees.append({r.chunk_id: r.label for r in hdbscan.hdbscan_labels(df, block_rows=block_rows).collect()})
    for doc, (first, x) in at.items():
        if len(x) > 1 and doc != "e":  # without ties the labels are the plain ones, by whatever names
            for labels in trees:
                pairs = set(zip([labels[first + i] for i in range(len(x))], plain_labels(x).tolist()))
                assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_copies_of_one_vector_end(spark):
    rows = [("s", i, [[float(i), 1.0], [1.0, 0.0], [5000.0, 0.0]][i % 3]) for i in range(15000)]
    df = spark.createDataFrame(rows, "source string, chunk_id long, embedding array<double>").where("chunk_id % 3 > 0 or chunk_id < 150")
    labels = {r.chunk_id: r.label for r in hdbscan.hdbscan_labels(df, block_rows=32).collect()}
    assert len(labels) == 10050
    first, second = ({labels[i] for i in range(15000) if i % 3 == j} for j in (1, 2))
    assert len(first) == len(second) == 1 and first != second and min(first | second) >= 0
