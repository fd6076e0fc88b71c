"""Ranked search against plain scoring of every document, and the treap against plain sums."""

import math
import random
import re
from collections import Counter

import numpy as np

from ragloom.llm import ranking

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


def plain(docs, items, k):
    held = [Counter(TERM.findall(lower(t))) for _, t in docs]
    n = [sum(c.values()) for c in held]
    N, L = sum(x > 0 for x in n), sum(n)
    df = Counter(t for c in held for t in c)
    out = []
    for item, text in items:
        asked, hits = Counter(TERM.findall(lower(text))), []
        for (d, _), c, x in zip(docs, held, n):
            s = sum(q * math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1)))
                    * ((1000000000 * c[t]) // (1000 * c[t] + 12 * (100 - 25 + 25 * x * N // L))) for t, q in asked.items() if c[t])
            if s > 0:
                hits.append((-s, d is None, d or 0, d))
        out += [(str(item), r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(hits)[:k])]
    return sorted(out, key=str)


def test_search_equals_plain_scoring(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(80)] + ["É", "é", "Ab9", "日本", "x_y"]
    text = lambda n: " ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(len(words))], k=n))
    docs = [(i, text(rng.randint(0, 60))) for i in range(400)]
    docs += [(1000, None), (1001, ""), (None, text(30)), (1002, text(20000)), (7, docs[7][1]), (1003, "-- ,,")]
    docs += [(2000 + i, "w79 w78 copy") for i in range(50)]
    items = [(i, text(rng.randint(1, 30))) for i in range(25)] + [(90, None), (91, "zzz"), (None, "w79 É"), (3, "w78 w78 w3"), (92, "")]
    d = spark.createDataFrame([(*r, 1, "z") for r in docs], "doc_id long, text string, score int, ROW string").repartition(5)
    q = spark.createDataFrame([(*r, 9) for r in items], "item_id long, text string, rank int")
    for k, size in ((20, 1 << 20), (3, 300)):
        got = ranking.search(d, q, k, item_bytes=size).collect()
        assert sorted(((str(r.item_id), r["rank"], r.doc_id, r.score) for r in got), key=str) == plain(docs, items, k)
    assert ranking.search(d.limit(0), q).count() == ranking.search(d, q.limit(0)).count() == 0


def test_treap_equals_plain_sums():
    rng = np.random.default_rng(5)
    for _ in range(150):
        n_rows, n_columns, n = rng.integers(1, 70), rng.integers(1, 300), rng.integers(1, 400)
        key = np.unique(rng.integers(0, n_rows * n_columns, n))
        row, column = key // n_columns, key % n_columns
        impact = rng.integers(1, 1000, len(key))
        treap = ranking.Treap(row, column, impact)
        assert (treap.side[:-1] == 0).sum() == len(key) and len(treap.side) <= 2 * len(key) + 1
        rows = rng.choice(n_rows, min(n_rows, 5), replace=False)
        weights = rng.integers(0, 20, len(rows))
        total = np.zeros(n_columns, np.int64)
        for r, w in zip(rows, weights):
            np.add.at(total, column[row == r], w * impact[row == r])
        k = int(rng.integers(1, 12))
        scores = sorted((s for s in total.tolist() if s > 0), reverse=True)
        least = scores[min(k, len(scores)) - 1] if scores else 1
        assert sorted(treap.best(rows, weights, k, 1)) == sorted((s, c) for c, s in enumerate(total.tolist()) if s >= least > 0 or False)
