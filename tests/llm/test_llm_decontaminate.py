"""Decontamination against a brute-force search of every window."""

import random
import re

import numpy as np

from ragloom.llm.decontaminate import contamination, kept, remove_contaminated, run_hashes, words


def brute(docs, items, window=13):
    def ws(t):
        lowered = re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)

    wins = {}
    for i, t in items:
        w = ws(t)
        n = min(window, len(w))
        for a in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[a:a + n]), set()).add(i)
    sizes = {len(k) for k in wins}
    out = []
    for d, t in docs:
        w = ws(t)
        hit, found = set(), set()
        for n in sizes:
            for a in range(len(w) - n + 1):
                if (got := wins.get(tuple(w[a:a + n]))) is not None:
                    hit |= set(range(a, a + n))
                    found |= got
        out.append((d, len(w), len(hit), sorted(str(i) for i in found), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def test_words():
    assert words("Añb-C 9_x É`~".encode()) == ["añb".encode(), b"c", b"9", "x É".encode()]
    assert words(None) == words(b"") == words(b" ,.") == []


def test_a_window_always_keeps_one_and_the_same():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 3, 400).astype(np.uint64)  # many ties
    g = run_hashes(h, 5)
    at = np.arange(len(g))
    k = kept(g, at, np.zeros(len(at), np.int64), np.full(len(at), len(h)), 13, 5)
    for s in range(len(h) - 12):
        w = g[s:s + 9]
        right_least = s + 8 - int(np.argmin(w[::-1]))
        assert k[right_least]


def test_contamination_equals_brute_force(spark):
    rng = random.Random(4)
    vocab = ["alpha", "Beta", "γ", "7", "d-e", "the"]
    text = lambda n: " ".join(rng.choices(vocab, k=n))  # noqa: E731  few words: many chance repeats
    items = [(i, text(rng.randint(1, 40))) for i in range(12)] + [(50, None), (51, ""), (52, "?!"), (53, "the the the")]
    items += [(60, items[0][1]), (None, text(20))]
    docs = [(i, text(rng.randint(0, 60))) for i in range(60)]
    for i in range(60, 120):
        t = items[rng.randrange(12)][1].split()
        a = rng.randrange(len(t))
        docs.append((i, text(30) + " " + ", ".join(t[a:a + 20]).upper() + "\n" + text(9)))
    docs += [(200, None), (201, ""), (202, "-"), (3, docs[3][1]), (None, items[1][1]), (203, (text(50) + " ") * 300 + items[2][1])]
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, hits int, ROW string").repartition(3)
    bench = spark.createDataFrame([(*i, 0) for i in items], "item_id long, text string, need int")
    got = [(r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in contamination(df, bench).collect()]
    want = brute(docs, items)
    want = [(a, b, c, [x for x in d if x != "None"], e) for a, b, c, d, e in want]
    assert sorted(got, key=str) == sorted(want, key=str)
    left = remove_contaminated(df, bench)
    assert left.columns == df.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(w[0]) for w in want if not w[4])
    assert contamination(df.limit(0), bench).count() == 0
    clean = contamination(df, bench.limit(0))
    assert clean.count() == len(docs) and clean.where("n_hit > 0 or contaminated").count() == 0
