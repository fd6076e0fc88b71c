"""Nearest-neighbour quality votes: against plain computations, accuracy on held-out rows, edge cases."""

import random
import zlib

import numpy as np
import pyarrow as pa

from ragloom.llm import quality


def made(n=900, seed=0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        w = [f"{rng.choice('abcdef')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{rng.randrange(50)}" for _ in range(rng.randint(8, 150))]
        bad = rng.random() < 0.25
        if bad:
            w = [x + rng.choice(["&&&", "###"]) for x in w] if rng.random() < 0.5 else [x for x in w for _ in range(2)]
        rows.append((i, " ".join(w), int(not bad)))
    return rows


def plain_counts(text):
    data = text.encode().translate(quality._SPACE)
    out = np.zeros(quality.WIDTH)
    for a, b, c in zip(data, data[1:], data[2:]):
        h = (a * 0x9E3779B1 + b * 0x85EBCA77 + c * 0xC2B2AE3D) % 2**32
        out[(((h ^ (h >> 15)) * 0x2C1B3C6D) % 2**32) >> 20] += 1
    words = [w for w in data.split(b" ") if w]
    if words:
        share = sum(a == b for a, b in zip(words, words[1:])) / len(words)
        out[quality.BUCKETS + min(quality.REPEATS - 1, int(share * quality.REPEATS))] = max(1, len(data))
    return out


def test_counts_and_votes_equal_plain_loops():
    rng = random.Random(2)
    texts = ["", None, " ", "a", "ab", "abc abc abc", "é è", "x\n\ny\ty y"] + [
        "".join(rng.choices(["ab ", "c", " ", "é", "\n", "ab "], k=rng.randint(0, 60))) for _ in range(60)]
    got = np.concatenate(list(quality.blocks(pa.array(texts))))
    assert np.array_equal(got, np.array([plain_counts(t or "") for t in texts], np.float32))
    rows = made(300, 3)
    x = np.concatenate(list(quality.blocks(pa.array([t for _, t, _ in rows]))))
    y = np.array([l for *_, l in rows], float)
    m = quality.fit(x, y, np.ones(quality.WIDTH, np.float32))
    ours = m.score(x[:40])
    for v, s in zip(m.latent(x[:40]), ours):
        near = sorted(((float(v @ u), l) for u, l in zip(m.vectors, y)), reverse=True)[:quality.NEIGHBOURS]
        w = [max(0, c) ** quality.SHARPNESS for c, _ in near]
        assert abs(s - sum(a * l for a, (_, l) in zip(w, near)) / sum(w)) < 1e-4


def test_held_out_accuracy_and_edges(spark):
    rows = made()
    extra = [(None, rows[0][1], 1), (5000, None, 1), (5001, "", 1), (5002, "ab1 ce2 " * 30000, 1), (3, rows[3][1], 0)]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t, _ in rows + extra], "doc_id long, text string, SCORE string, y int").repartition(4)
    held = {d for d, *_ in rows if zlib.crc32(str(d).encode()) % 5 == 0}
    labels = [(d, y) for d, _, y in rows] + [(None, 1), (7, None)]
    model = quality.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    other = quality.train(docs, spark.createDataFrame([(d, 1 - y if d in held else y) for d, y in labels if y is not None], "doc_id long, quality int"))
    assert len(model.labels) == len(rows) - len(held) and model.labels.sum() == other.labels.sum()
    out = quality.score(docs, model, out="s").collect()
    truth = {d: y for d, _, y in rows}
    assert len(out) == len(rows + extra) and all(0 <= r.s <= 1 for r in out)
    assert np.mean([(r.s >= 0.3) == truth[r.doc_id] for r in out if r.doc_id in held]) > 0.95
    by_id = {r.doc_id: r.s for r in out}
    assert abs(by_id[5000] - model.labels.mean()) < 1e-12 and by_id[5000] == by_id[5001]
    assert quality.keep_good(docs, spark.createDataFrame(labels, "doc_id long, quality int")).columns == docs.columns
    small = quality.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"), max_labelled=50)
    assert len(small.labels) == 50


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.score(docs, quality.train(docs, labels)).collect()[0].score == 0.0
    assert quality.keep_good(docs, labels).count() == 1
    assert quality.score(docs.limit(0), quality.train(docs.limit(0), labels)).count() == 0
