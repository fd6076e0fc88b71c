"""Positive-unlabelled toxicity: accuracy on held-out rows, and edge cases."""

import random
import zlib

import numpy as np

from ragloom.llm import toxicity


def made(n=1500, seed=0):
    rng = random.Random(seed)
    bad = [f"vile{c}" for c in "abcdefghij"]
    rows = []
    for i in range(n):
        w = [f"w{rng.randrange(400)}" for _ in range(rng.randint(5, 120))]
        toxic = rng.random() < 0.2
        for _ in range(rng.randint(1, 4) if toxic else 0):
            w.insert(rng.randrange(len(w) + 1), rng.choice(bad))
        rows.append((i, " ".join(w), int(toxic)))
    return rows


def test_held_out_accuracy_and_edges(spark):
    rows = made()
    extra = [(None, "vilea vileb", 0), (5000, None, 0), (5001, "", 0), (5002, "w1 " * 50000 + "vilea vileb vilec", 1), (3, rows[3][1], 0)]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t, _ in rows + extra], "doc_id long, text string, SCORE string, found int")
    labels = spark.createDataFrame([(d, y) for d, _, y in rows if d % 3] + [(None, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    out = toxicity.score(docs, model, out="s").select("doc_id", "text", toxicity.held_out("doc_id").alias("held_out"), "s").collect()
    truth = {d: y for d, _, y in rows + extra}
    assert len(out) == len(rows + extra)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out if r.doc_id is not None)
    held = [(r.s >= 0.5, truth[r.doc_id]) for r in out if r.doc_id is not None and r.held_out]
    assert np.mean([a == b for a, b in held]) > 0.95
    by_id = {r.doc_id: r.s for r in out}
    assert by_id[5000] == by_id[5001] < 0.5 and by_id[5002] >= 0.5 and by_id[None] >= 0.5
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.s < 0.5 for r in out)


def test_labels_of_held_out_rows_and_order_do_not_matter(spark):
    rows = made(600, 1)
    docs = spark.createDataFrame([(d, t) for d, t, _ in rows], "doc_id long, text string")
    held = {d for d, _, _ in rows if zlib.crc32(str(d).encode()) % 5 == 0}
    a = toxicity.train(docs, spark.createDataFrame([(d, y) for d, _, y in rows], "doc_id long, toxic int"))
    b = toxicity.train(docs, spark.createDataFrame([(d, 1 - y if d in held else y) for d, _, y in rows], "doc_id long, toxic int"))
    assert a.weights.keys() == b.weights.keys() and np.allclose(a.bias, b.bias)


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.train(docs, labels)).collect()[0].score == 0.0
    assert toxicity.score(docs.limit(0), toxicity.train(docs.limit(0), labels)).count() == 0


def test_risk_slopes_equal_differences():
    """Against numerical slopes of the risk, and of the corrected part's negative where that part is below zero."""
    rng = np.random.default_rng(3)
    is_pos = np.arange(40) < 10
    reversed_ = 0
    for prior, shift in ((0.2, 0.0), (0.6, 0.0), (0.5, 6.0), (0.3, -4.0)):
        z = rng.normal(size=40) + np.where(is_pos, shift, -shift)

        def parts(z):
            positive = prior * np.logaddexp(0, -z[is_pos]).mean()
            return positive, np.logaddexp(0, z[~is_pos]).mean() - prior * np.logaddexp(0, z[is_pos]).mean()

        below = parts(z)[1] < 0
        reversed_ += below
        risk = (lambda z: -parts(z)[1]) if below else (lambda z: sum(parts(z)))
        step = np.eye(40) * 1e-6
        assert np.allclose(toxicity.risk_slopes(z, is_pos, prior), [(risk(z + e) - risk(z - e)) / 2e-6 for e in step], atol=1e-6)
    assert 0 < reversed_ < 4


def test_a_prior_of_one_half_without_features_drops_nothing(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a b", "c d", None, "", "e f", "g h"])], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (1, 0), (4, 1), (5, 0)], "doc_id long, toxic int")
    assert toxicity.drop_toxic(docs, labels).count() == 6
