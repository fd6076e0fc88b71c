"""Personal data: base spans against the plain patterns, added spans and redaction by cases."""

import random
import re

import pytest

from ragloom.llm import pii

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def plain_spans(text, kind):
    out = []
    for m in re.finditer(PLAIN[kind], text or ""):
        d = re.sub("[^0-9]", "", m.group())
        if (kind == "ip" and any(int(p) > 255 for p in m.group().split(".")) or kind == "phone" and not 9 <= len(d) <= 15
                or kind == "card" and not (13 <= len(d) <= 19 and luhn(d))):
            continue
        out.append((m.start(), m.end()))
    return out


CASES = [None, "", "a", "mail x.y@a-b.co.uk, z@b c@d.e_f@g.h", "1.2.3.4.5.6.7.8 256.1.1.1 0001.002.3.255 1.2.3", "4111 1111-1111 1111 x",
         "41111111111111111111111", "4111111111111111 1", "é😀 +1 (017) 555-7713 ü 4111111111111111", "+1+23456789012+1 2",
         "+123456789012345678", "a@b.c@d.e", "@@a@@b.c", "....@....", "-@-.-", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6  7", "0000000000000000000",
         "x" * 50000 + "@", "1" * 50000, "1." * 30000, "a." * 30000 + "@" + "b." * 30000 + "c", "+1 " * 20000,
         "q 10.0.0.1 " * 3000, "1-" * 30000, "\n+1 (017)\n555 9.9.9.9\t"]


def random_texts(n):
    rng = random.Random(7)
    bits = ["4111111111111111", "1", "22", ".", "+", " ", "-", "@", "a", "é", "a.b", "255", "(", ")", "+1 (017) 555-7713", "m@n.oo", "\n"]
    return ["".join(rng.choices(bits, k=rng.randint(1, 30))) for _ in range(n)]


def test_base_spans_equal_the_plain_patterns(spark):
    texts = CASES + random_texts(400)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, Email string").repartition(4)
    rows = pii.spans(df, pii.NO_MODEL)
    assert rows.columns[:4] == ["doc_id", "text", "Email", "email_"]
    for r in rows.collect():
        for kind, col in zip(pii.KINDS, rows.columns[3:7]):
            assert [(s.start, s.end) for s in r[col]] == plain_spans(texts[r.doc_id], kind), (kind, (texts[r.doc_id] or "")[:80])
            assert all(s.m == texts[r.doc_id][s.start:s.end] for s in r[col])
        assert not any(r[c] for c in rows.columns[7:])
    assert pii.spans(df.limit(0), pii.NO_MODEL).count() == 0


def corpus(n=600):
    rng = random.Random(3)
    out = []
    for i in range(n):
        w = [rng.choice(["le", "mot", "word", "der", "Satz"]) for _ in range(20)]
        d = "".join(rng.choices("0123456789", k=15))
        d += next(c for c in "0123456789" if luhn(d + c))
        w.insert(5, rng.choice([f"mail a{i}@b.com", f"call +1 (212) 555-{rng.randint(1000, 9999)}", f"ip 10.0.0.{rng.randint(1, 600)}",
                                f"card {d}", f"id {d[:-1]}{(int(d[-1]) + 1) % 10}", f"x{d}y", f"ref +1 ({i})"]))
        out.append(" ".join(w))
    return out


def test_model_adds_free_spans_only(spark):
    extra = ["call (212) 555-0000 now", "call +1 (212) 555-0000 now", "write joe (at) site (dot) org", "x212y", "card 4111 1111 1111 1112"]
    texts = corpus() + extra + [None, ""]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, _all int")
    model = pii.train(df)
    assert model.trees and set(model.least) == set(pii.KINDS)
    model.least.update(phone=0.0, email=0.0)  # whatever is proposed
    rows = pii.spans(df, model).collect()
    for r in rows:
        base = [s for k in pii.KINDS for s in r[k]]
        more = sorted((s.start, s.end) for k in pii.KINDS for s in r[f"more_{k}"])
        assert all(a[1] <= b[0] for a, b in zip(more, more[1:]))
        assert all(b <= s.start or a >= s.end for a, b in more for s in base)
    found = {r.doc_id: r for r in rows}
    first = len(corpus())
    assert [s.m for s in found[first].more_phone] == ["(212) 555-0000"] and not found[first + 1].more_phone
    assert [s.m for s in found[first + 2].more_email] == ["joe (at) site (dot) org"]
    clean = {r.doc_id: r.text for r in pii.redact(df, model).collect()}
    assert clean[first] == "call [PHONE] now" == clean[first + 1] and clean[first + 2] == "write [EMAIL]"
    assert clean[first + 5] is None and clean[first + 6] == "" and clean[first + 3] == "x212y"


def test_trees_as_expression_equal_spark_ml(spark):
    df = spark.createDataFrame([(t,) for t in corpus(200)], "text string")
    model = pii.train(df)
    assert pii.train(df.limit(0)) is pii.NO_MODEL
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([([float(i % 7), float(i % 5), float(i)], float(i % 3 == 0)) for i in range(300)], "x array<double>, label double")
    gbt = GBTClassifier(maxIter=8, maxDepth=4, seed=1).fit(rows.select(array_to_vector("x").alias("features"), "label"))
    own = pii.Model([t.toDebugString for t in gbt.trees], list(gbt.treeWeights), {})
    out = gbt.transform(rows.withColumn("features", array_to_vector("x"))).select(
        vector_to_array("probability")[1].alias("p"), own.score(F.col("x")).alias("q")).collect()
    assert all(r.p == pytest.approx(r.q, abs=1e-9) for r in out)
    assert model.least.keys() == set(pii.KINDS)


def test_redact_equals_spans(spark):
    texts = CASES[:17] + random_texts(100)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.redact(df, pii.NO_MODEL).collect():
        if texts[r.doc_id] is None:
            assert r.text is None
            continue
        if not any(plain_spans(texts[r.doc_id], k) for k in pii.KINDS):
            assert r.text == texts[r.doc_id]
        assert not any(plain_spans(r.text, k) for k in pii.KINDS)


def test_all_candidates_train(spark, monkeypatch):
    texts = [" ".join(f"mail u{i}x{j}@b{j}.org to 10.0.{j}.{300 if j % 3 else 7}" for j in range(50)) for i in range(450)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen = []
    plain = pii.materialize
    monkeypatch.setattr(pii, "materialize", lambda d: seen.append(plain(d)) or seen[-1])
    monkeypatch.setattr(pii, "GBTClassifier", lambda **kw: pytest.importorskip("pyspark.ml.classification").GBTClassifier(maxIter=1, maxDepth=1, seed=7))
    model = pii.train(df)
    n_email = seen[0].where("kind = 'email'").count()
    assert n_email == 450 * 50  # more than 20,000, none left out
    assert set(model.least) == set(pii.KINDS)
