"""HDBSCAN labels per document (J2), after Campello, Moulavi & Sander (2013).

Steps for one document's vectors: core distance (distance to the ``core_k``-th
nearest other vector), mutual reachability ``max(core_a, core_b, d(a, b))``,
minimum spanning tree, single-linkage merges in edge order, condensed tree
for ``min_cluster_size``, cluster stability, excess-of-mass selection. The root is
never selected, so a document that forms one single group comes out all noise.

The tree comes from ``spanning_tree``, which spreads a large document over many tasks. Only its n - 1
edges meet in one task per document for the walk (``groupBy(source).applyInPandas``), which is linear in them
but for a sort.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ragloom import constants as C
from ragloom.operators.spanning_tree import BLOCK_ROWS, spanning_tree

def _merges(n: int, edges):
    """Single-linkage merges: rows (left, right, dist, size) with new node ids n, n+1, ..."""
    parent = list(range(2 * n))
    size = [1] * n + [0] * n

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    rows = []
    for k, (a, b, w) in enumerate(sorted(edges, key=lambda e: e[2])):
        ra, rb = find(a), find(b)
        node = n + k
        size[node] = size[ra] + size[rb]
        parent[ra] = parent[rb] = node
        rows.append((ra, rb, w, size[node]))
    return rows


def tree_labels(n: int, edges, min_cluster_size: int) -> np.ndarray:
    """Labels of the points 0 to n - 1 from the edges (a, b, distance) of their spanning tree."""
    if n < 2:
        return np.full(n, C.NOISE_LABEL)
    merges = _merges(n, edges)
    children = {n + i: (l, r, w, s) for i, (l, r, w, s) in enumerate(merges)}

    def count(node):
        return children[node][3] if node >= n else 1

    def leaves(node):
        out, stack = [], [node]
        while stack:
            v = stack.pop()
            if v < n:
                out.append(v)
            else:
                stack.extend(children[v][:2])
        return out

    # condensed tree: clusters with birth lambda, points leaving each cluster at a lambda
    root = 2 * n - 2
    birth = {0: 0.0}
    parent_of = {}
    leave = {}  # cluster -> list of (lambda, count) of points falling out
    member_root = {}  # point -> cluster it falls out of
    stack = [(root, 0)]
    next_id = 1
    while stack:
        node, cid = stack.pop()
        if node < n:
            continue
        l, r, w, _ = children[node]
        lam = 1.0 / w if w > 0 else np.inf
        big_l, big_r = count(l) >= min_cluster_size, count(r) >= min_cluster_size
        if big_l and big_r:
            for child in (l, r):
                birth[next_id] = lam
                parent_of[next_id] = cid
                stack.append((child, next_id))
                next_id += 1
        else:
            for child, big in ((l, big_l), (r, big_r)):
                if big:
                    stack.append((child, cid))
                else:
                    for p in leaves(child):
                        leave.setdefault(cid, []).append((lam, 1))
                        member_root[p] = cid
    # stability: points falling out, plus whole child clusters leaving at their birth
    stab = {c: 0.0 for c in birth}
    for c, items in leave.items():
        stab[c] += sum((min(lam, 1e300) - birth[c]) * cnt for lam, cnt in items)
    kids = {c: [] for c in birth}
    for c, p in parent_of.items():
        kids[p].append(c)
    sizes = {c: len(leave.get(c, [])) for c in birth}
    for c in sorted(parent_of, reverse=True):  # children have larger ids than their parents
        sizes[parent_of[c]] += sizes[c]
    for c, p in parent_of.items():
        stab[p] += (min(birth[c], 1e300) - birth[p]) * sizes[c]
    # excess of mass, children before parents (ids grow downwards), root excluded
    selected = {}
    best = dict(stab)
    for c in sorted(birth, reverse=True):
        if c == 0:
            continue
        sub = sum(best[k] for k in kids[c])
        if kids[c] and sub > stab[c]:
            selected[c] = False
            best[c] = sub
        else:
            selected[c] = True
            todo = list(kids[c])
            while todo:
                k = todo.pop()
                selected[k] = False
                todo.extend(kids[k])
    chosen = sorted(c for c, s in selected.items() if s)
    label_of = {c: i for i, c in enumerate(chosen)}
    out = np.full(n, C.NOISE_LABEL)
    for p, c in member_root.items():
        a = c
        while a != 0 and a not in label_of:
            a = parent_of[a]
        if a in label_of:
            out[p] = label_of[a]
    return out


def hdbscan_labels(chunks: DataFrame, group: str = "source", id_col: str = "chunk_id", vec_col: str = "embedding",
                   min_cluster_size: int = 2, core_k: int = 2, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(chunk_id, label)`` per document, noise = -1 (J2); documents with fewer than two
    vectors are left out, as the loader skips them (J3)."""
    edges = spanning_tree(chunks, group, id_col, vec_col, core_k, block_rows)

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["distance", "a", "b"])
        ids, at = np.unique(np.concatenate([pdf["a"], pdf["b"]]), return_inverse=True)
        a, b = np.split(at, 2)
        labels = tree_labels(len(ids), list(zip(a.tolist(), b.tolist(), pdf["distance"].tolist())), min_cluster_size)
        return pd.DataFrame({id_col: ids, "label": labels})

    return edges.groupBy(group).applyInPandas(fn, f"{id_col} long, label long")
