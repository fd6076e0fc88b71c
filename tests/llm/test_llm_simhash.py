"""SimHash: fingerprints, links and components against brute force."""

import itertools
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from ragloom.llm import simhash


def brute_fingerprint(text, n=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    grams = [" ".join(w[i:i + n]) for i in range(max(1, len(w) - n + 1))] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, radius):
    """fps: {id: fingerprint} -> {id: smallest id reachable}"""
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(fps, 2):
        if (fps[a] ^ fps[b]).bit_count() <= radius:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in fps}


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_masks_cover_every_pair_within_the_radius(radius):
    masks = simhash.covering_masks(radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    for bits in itertools.combinations(range(64), radius):
        d = sum(1 << b for b in bits)
        assert any(m & d == 0 for m in masks)


@pytest.mark.parametrize("text", ["", None, "One", "two Words", "a b c", " É  é\tx\x0bY\n z\x1cq ", "a b c a b c a", "x " * 700])
def test_fingerprint(text):
    assert simhash.fingerprint(None if text is None else text.encode(), 3) == brute_fingerprint(text)


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_links_equal_all_pairs(spark, radius):
    rng = random.Random(radius)
    centres = [rng.getrandbits(64) for _ in range(12)]
    fps = {c for c in centres}
    for c in centres:  # balls and chains, also one dense ball
        x = c
        for _ in range(25):
            x ^= 1 << rng.randrange(64)
            fps.add(x)
            fps.add(c ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    fps |= {centres[0] ^ (a | b << 7) for a in range(8) for b in range(8)}
    ids = dict(enumerate(sorted(fps, key=simhash._signed)))
    df = spark.createDataFrame([(simhash._signed(x),) for x in ids.values()], "fp long")
    edges = simhash.links(df, radius)
    assert edges.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) > radius).count() == 0
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    for i, r in brute_components(ids, radius).items():
        fp = simhash._signed(ids[i])
        assert got.get(fp, fp) == simhash._signed(ids[r])


def test_components_of_a_long_chain(spark):
    nodes = list(range(300))
    random.Random(0).shuffle(nodes)
    df = spark.createDataFrame(list(zip(nodes, nodes[1:])) + [(1000, 1001), (1001, 1001)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(df).collect()}
    assert got == {n: 0 for n in range(1, 300)} | {1001: 1000}
    assert simhash.components(df.limit(0)).count() == 0


def test_near_duplicates_and_deduplicate(spark):
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(300)]
    docs = []
    for i in range(40):
        w = rng.choices(vocab, k=rng.randint(1, 400))
        docs.append((100 + i, " ".join(w)))
        for j in range(3):
            v = w[:]
            v[rng.randrange(len(v))] = "changed"
            docs.append((1000 + 10 * i + j, " ".join(v).upper()))
    docs += [(7, None), (8, ""), (9, " \n"), (100, docs[0][1]), (100, "another text with the same id"), (None, docs[4][1]),
             (None, "no id at all"), (None, "no id at all"), (5, "x " * 30000)]
    df = spark.createDataFrame([(*d, "n", 0) for d in docs], "doc_id long, text string, fp string, Root int")
    rows = simhash.near_duplicates(df, 3, 2).collect()
    fps = {i: brute_fingerprint(t) for i, (_, t) in enumerate(docs)}
    comp = brute_components(fps, 2)
    least = {}
    for i, c in comp.items():
        if docs[i][0] is not None:
            least[c] = min(least.get(c, 1 << 62), docs[i][0])
    want = sorted(((docs[i][0], simhash._signed(fps[i]), least.get(c)) for i, c in comp.items()), key=str)
    assert sorted(((r.doc_id, r.fp, r.component_id) for r in rows), key=str) == want
    kept = simhash.deduplicate(df, 3, 2)
    assert kept.columns == df.columns
    got = kept.collect()
    assert len(got) == len(set(comp.values()))
    classes = {comp[next(i for i, d in enumerate(docs) if d == (r.doc_id, r.text))] for r in got}
    assert classes == set(comp.values())
    for r in got:
        c = comp[next(i for i, d in enumerate(docs) if d == (r.doc_id, r.text))]
        assert r.doc_id == least.get(c)
    assert simhash.near_duplicates(df.limit(0)).count() == 0 and simhash.deduplicate(df.limit(0)).count() == 0
