"""Answer assembly edge rows and metric formulas against direct Python statements."""

import collections
import math
import random

from pyspark.sql import functions as F

from ragloom import constants as C
from ragloom.operators import answer as A
from ragloom.operators import metrics as M


def test_parse_explanations_edges(spark):
    reply = ("Intro before any document\n"
             "Document: a.pdf\nExplanation: first text\n\n"
             "document- b.pdf\n  - second  \n"
             "Document: my file.pdf\nstray line\n"
             "Document: a.pdf\nExplanation: restated")
    df = spark.createDataFrame([(1, reply)], "query_id long, reply string")
    got = {r.doc: r.explanation for r in A.parse_explanations(df).collect()}
    assert got["a.pdf"] == "restated "
    # the file name with a space never opens a section: its lines stay with b.pdf
    assert got["b.pdf"] == "second Document: my file.pdf stray line "
    assert set(got) == {"a.pdf", "b.pdf"}


def test_context_and_template_fill(spark):
    hits = spark.createDataFrame([(1, 2, "second"), (1, 1, "first {question}")],
                                 "query_id long, rerank long, content string")
    ctx = A.context_string(hits).first().context
    two = {r.query_id: (r.context, r.n_hits) for r in A.context_string(
        hits, questions=spark.createDataFrame([(1,), (2,)], "query_id long")).collect()}
    assert two == {1: (ctx, 2), 2: (C.CONTEXT_HEADER, 0)}  # without hits the header alone
    assert ctx == "\nExtracted documents:\nDocument 0\nfirst {question}Document 1\nsecond"
    q = spark.createDataFrame([(1, "Q?")], "query_id long, query_text string")
    p = A.prompt_table(q, A.context_string(hits)).first()
    assert p.template == "context"
    assert p.user_prompt == C.CHAT_USER_WITH_CONTEXT.format(context=ctx, chat_history=C.NO_HISTORY, question="Q?")


def test_chat_history_roles(spark):
    m = spark.createDataFrame([(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 2, "system", "c")],
                              "conv_id long, turn long, role string, text string")
    assert A.chat_history(m).first().chat_history == "user: a\nassistant: b\nassistant: c"


def _ngrams(t, n):
    return collections.Counter(tuple(t[i:i + n]) for i in range(len(t) - n + 1))


def py_bleu(pairs, tok):
    m, poss, lp, lr = [0] * 4, [0] * 4, 0, 0
    for ref, pred in pairs:
        r, p = tok(ref), tok(pred)
        lp += len(p)
        lr += len(r)
        for n in range(1, 5):
            ov = _ngrams(p, n) & _ngrams(r, n)
            m[n - 1] += sum(ov.values())
            poss[n - 1] += max(len(p) - n + 1, 0)
    prec = [m[i] / poss[i] if poss[i] else 0.0 for i in range(4)]
    geo = math.exp(sum(0.25 * math.log(x) for x in prec)) if min(prec) > 0 else 0.0
    ratio = lp / lr
    return geo * (1.0 if ratio > 1 else math.exp(1 - 1 / ratio))


def test_bleu_rouge_against_python(spark):
    pairs = [("the cat sat on the mat today", "the cat sat on a mat today"),
             ("a quick brown fox jumps", "a quick brown fox jumps over"),
             ("Hello, world. 3.5 apples-2", "hello world 3.5 apples")]
    df = spark.createDataFrame([(i, r, p) for i, (r, p) in enumerate(pairs)], "qid long, reference string, prediction string")
    toks = {r.x: r.t for r in spark.createDataFrame([(x,) for pr in pairs for x in pr], "x string")
            .select("x", M.bleu_tokens("x").alias("t")).collect()}
    assert toks["Hello, world. 3.5 apples-2"] == ["Hello", ",", "world", ".", "3.5", "apples-2"]
    got = M.bleu(df).first().bleu
    assert abs(got - py_bleu(pairs, lambda s: toks[s])) < 1e-12
    rl = {r.qid: r.rougeL_f1 for r in M.rouge_l(df).collect()}
    assert abs(rl[0] - 2 * (6 / 7) * (6 / 7) / (12 / 7)) < 1e-12
    rn = {r.qid: (r.rouge1_f1, r.rouge2_f1) for r in M.rouge_n(df).collect()}
    assert abs(rn[1][0] - 2 * (5 / 6) * 1.0 / (5 / 6 + 1.0)) < 1e-12


def test_lcs_dynamic_program():
    assert M._lcs(list("ABCBDAB"), list("BDCABA")) == 4
    assert M._lcs([], ["a"]) == 0


def test_resampled_means_equal_plain_poisson_draws(spark):
    import hashlib

    rows = [(i, (i * 37 % 11) / 10, None if i == 3 else 0.5) for i in range(40)]
    got = {r.measure: (r.low, r.mid, r.high) for r in M.resampled(
        spark.createDataFrame(rows, "qid long, a double, b double").repartition(3), "qid", ["a", "b"], replicates=50).collect()}
    draw = lambda i, r: sum(int(hashlib.md5(f"{i}:{r}".encode()).hexdigest()[:8], 16) / 2**32 >= p for p in M._POISSON)
    for name, column in (("a", 1), ("b", 2)):
        means = sorted(sum(draw(x[0], r) * (x[column] or 0) for x in rows) / sum(draw(x[0], r) for x in rows) for r in range(1, 51))
        assert all(abs(v - means[at]) < 1e-9 for v, at in zip(got[name], (1, 24, 48), strict=True))
    none = M.resampled(spark.createDataFrame([], "qid long, a double"), "qid", ["a"], replicates=5).collect()
    assert [(r.measure, r.low, r.mid, r.high) for r in none] == [("a", None, None, None)]


def test_bit_parallel_lcs_equals_the_plain_table(monkeypatch):
    rng = random.Random(3)

    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
            row = new
        return row[-1]

    for block in (1, 7, 64, 4096):
        monkeypatch.setattr(M, "_BLOCK", block)
        for n, m, v in [(0, 5, 2), (5, 0, 2), (1, 1, 1), (63, 64, 2), (64, 65, 30), (200, 129, 3), (130, 300, 200)]:
            a, b = ([str(rng.randrange(v)) for _ in range(k)] for k in (n, m))
            assert M._lcs(a, b) == plain(a, b)


def test_rouge_l_of_null_empty_and_long_texts(spark):
    words = [f"w{i % 977}" for i in range(20000)]
    rows = [(1, None, "a"), (2, "", ""), (3, "A b, c", "a x c"), (4, " ".join(words), " ".join(words[1:] + ["end"]))]
    got = {r.qid: r.rougeL_f1 for r in M.rouge_l(spark.createDataFrame(rows, "qid long, reference string, prediction string")).collect()}
    assert got[1] == got[2] == 0.0 and abs(got[3] - 2 / 3) < 1e-12 and abs(got[4] - 19999 / 20000) < 1e-12
