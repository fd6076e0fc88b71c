"""Secret scans: findings against a plain search, and the forest's verdicts on held-out labels."""

import random
import re

import pytest
from pyspark.sql import functions as F

from ragloom.llm import secrets


def corpus(n=500, seed=0):
    rng = random.Random(seed)
    words = ["international", "communication", "word", "text", "understanding", "representation", "a"]
    out = []
    for i in range(n):
        w = [rng.choice(words) for _ in range(30)]
        w[3] = rng.choice(words) + rng.choice(words) + "ization"
        kind = i % 4
        value = "".join(rng.choices("0123456789abcdef", k=40))
        if kind == 0:
            w.insert(9, f'token = "{value}"')
        elif kind == 1:
            w.insert(9, f"example key: {value}")
        out.append((i, " ".join(w), ["src/main.py", "tests/x.py"][i % 2]))
    return out


def test_findings_and_verdicts(spark):
    rows = corpus()
    extra = [(900, None, "p"), (901, "", None), (None, 'password: "Zx81-kkQ9_aa71Lm0p2" é', "p"), (902, "x" * 60000 + " é😀 " + "ab1" * 7, "p")]
    df = spark.createDataFrame([(*r, 1, "t") for r in rows + extra], "doc_id long, text string, source string, m int, path string").repartition(4)
    found = secrets.scan(df).collect()
    texts = {r[0]: r[1] for r in rows + extra}
    want = sorted((str(d), m.start(), m.end(), m.group()) for d, t in texts.items() for m in re.finditer(r"[A-Za-z0-9+/_=-]{16,}", t or ""))
    assert sorted((str(r.doc_id), r.start, r.end, r.secret_text) for r in found) == want
    for r in found:
        if r.doc_id is not None and r.doc_id < 900:
            assert r.secret == (r.doc_id % 4 == 0 and len(r.secret_text) == 40), (r.score, r.secret_text)
        assert 0 <= r.score <= 1
    hidden = spark.createDataFrame(found, "doc_id long, start int, end int, secret_text string, score double, secret boolean")
    clean = secrets.redact(df, hidden)
    assert clean.columns == df.columns
    for r in clean.collect():
        secret = r.doc_id is not None and r.doc_id % 4 == 0 and r.doc_id < 900
        assert ("[SECRET]" in (r.text or "")) == secret or r.doc_id in (None, 902)


def test_statistics(spark):
    df = spark.createDataFrame([("abab abcd",), ("ABAB x",), (None,)], "text string")
    row = secrets.statistics(df).first()
    assert (len(row.pairs), len(row.grams)) == (676, 4096) and max(row.pairs) == row.pairs[1]  # "ab"
    assert 1 <= sum((g % 2**64).bit_count() for g in row.grams) <= 2  # "abab", "abcd"


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "a 0123456789abcdef0123", "p")], "doc_id long, text string, source string")
    assert [r.score for r in secrets.scan(df).collect()] == [0.0]
    assert secrets.scan(df.limit(0)).count() == 0


def test_features_of_long_findings_cover_all_positions(spark):
    rng = random.Random(4)
    long_ = ["".join(rng.choices("abcdeQ7", k=k)) + "international" * 90 for k in (16, 250, 4000)] + ["x" * n for n in (16, 256, 257, 258, 259, 260, 513)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(long_ + ["international banana abcde"])], "doc_id long, text string")
    stats = secrets.statistics(docs.where("doc_id >= 10"))
    pairs, grams = stats.first()
    found = {r.doc_id: r.x for r in secrets.findings(docs, stats, path_col=None).collect()}
    every = sorted({t.lower()[i:i + 4] for t in long_ for i in range(len(t) - 3)})
    place = {r.g: r.p for r in spark.createDataFrame([(g,) for g in every], "g string").select("g", secrets._gram_place(F.col("g")).alias("p")).collect()}
    for i, t in enumerate(long_):
        low = t.lower()
        usual = [pairs[(ord(a) - 97) * 26 + ord(b) - 97] if a.isalpha() and b.isalpha() else -12.0 for a, b in zip(low, low[1:])]
        held = [grams[place[low[j:j + 4]] >> 6] >> (place[low[j:j + 4]] & 63) & 1 for j in range(len(low) - 3)]
        assert found[i][2] == pytest.approx(sum(usual) / len(usual)) and found[i][3] == pytest.approx(sum(held) / len(held))


def test_copies_do_not_fill_the_sample(spark):
    rows = [([float(v), 1.0], y) for y in (0.0, 1.0) for v in range(8) for _ in range(1 + 300 * (v == 3))] + [([9.0, 9.0], None)]
    got = secrets.sample(spark.createDataFrame(rows, "x array<double>, label double").repartition(4), 8).collect()
    assert sorted((r.label, r.x[0], r.w) for r in got) == [(y, float(v), 301.0 if v == 3 else 1.0) for y in (0.0, 1.0) for v in range(8)]
    assert len(secrets.sample(spark.createDataFrame(rows, "x array<double>, label double"), 3).collect()) == 6
