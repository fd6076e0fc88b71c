"""Lexical and vector search against brute force on small hand-made tables."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from ragloom.operators import fusion, lexical, vector_search


def brute_cover_density(tokens, lexemes):
    lex = set(lexemes)
    occ = [i + 1 for i, t in enumerate(tokens) if t in lex]
    if not lex or not lex <= set(tokens):
        return None
    covers = []
    for p, q in itertools.combinations_with_replacement(occ, 2):
        if set(t for t in tokens[p - 1:q] if t in lex) == lex:
            covers.append((p, q))
    minimal = [(p, q) for p, q in covers
               if not any((a, b) != (p, q) and p <= a and b <= q for a, b in covers)]
    score = 0.0
    for p, q in minimal:
        m = sum(1 for x in occ if p <= x <= q)
        score += 0.1 / (1 + (q - p) - (m - 1))
    return score


def test_cover_density_matches_brute_force(spark):
    rnd = random.Random(7)
    vocab = ["alpha", "beta", "gamma", "delta", "eps"]
    docs, queries, expect = [], [], {}
    for cid in range(60):
        toks = [rnd.choice(vocab) for _ in range(rnd.randint(1, 25))]
        docs.append((cid, " ".join(toks)))
    for qid in range(6):
        lex = rnd.sample(vocab[:4], rnd.randint(1, 3))
        queries.append((qid, " ".join(lex)))
        for cid, text in docs:
            s = brute_cover_density(text.split(), lex)
            if s is not None:
                expect[(qid, cid)] = round(s, 9)
    ch = spark.createDataFrame(docs, "chunk_id long, content string")
    q = spark.createDataFrame(queries, "query_id long, query_text string")
    for limit in (None, 10):  # broadcast scan, then the shuffled path
        got = {(r.query_id, r.chunk_id): r.rank_bm25
               for r in lexical.lexical_match(ch, q, broadcast_limit_bytes=limit).collect()}
        assert got.keys() == expect.keys()
        for k, v in expect.items():
            assert abs(got[k] - v) < 1e-9


def test_single_lexeme_rank_is_tenth_of_tf(spark):
    ch = spark.createDataFrame([(1, "a b a c a")], "chunk_id long, content string")
    q = spark.createDataFrame([(9, "a")], "query_id long, query_text string")
    assert lexical.lexical_match(ch, q).first().rank_bm25 == 0.3


def test_empty_and_accented_queries_match_nothing(spark):
    ch = spark.createDataFrame([(1, "été café")], "chunk_id long, content string")
    q = spark.createDataFrame([(1, "   "), (2, "été"), (3, "ete")], "query_id long, query_text string")
    got = {r.query_id for r in lexical.lexical_match(ch, q).collect()}
    assert got == {3}  # content is accent-folded, the query is not


def _vectors(n, dim, rnd):
    return [list(map(float, rnd.normal(size=dim))) for _ in range(n)]


def test_semantic_topk_matches_numpy_and_blocks(spark):
    rnd = np.random.default_rng(3)
    dim, k = 8, 5
    cv = _vectors(200, dim, rnd)
    cv[5] = None              # NULL vector is skipped
    cv[6] = [0.0] * dim       # zero vector is skipped
    cv[7] = [1.0] * (dim + 1)  # wrong width is skipped
    cv[8] = cv[9]             # identical vectors tie, broken by chunk_id
    qv = _vectors(13, dim, rnd)
    ch = spark.createDataFrame(list(enumerate(cv)), "chunk_id long, embedding array<double>").repartition(4)
    q = spark.createDataFrame(list(enumerate(qv)), "query_id long, query_vec array<double>")
    one = {(r.query_id, r.rank): r.chunk_id for r in vector_search.semantic_topk(ch, q, k, dim=dim).collect()}
    many = {(r.query_id, r.rank): r.chunk_id
            for r in vector_search.semantic_topk(ch, q, k, dim=dim, broadcast_limit_bytes=300).collect()}
    assert one == many
    ok = [i for i, v in enumerate(cv) if v is not None and len(v) == dim and any(v)]
    m = np.array([cv[i] for i in ok])
    m = m / np.linalg.norm(m, axis=1)[:, None]
    for qi, v in enumerate(qv):
        s = (1 + m @ (np.array(v) / np.linalg.norm(v))) / 2
        order = sorted(range(len(ok)), key=lambda j: (-round(s[j], 9), ok[j]))[:k]
        assert [one[(qi, r + 1)] for r in range(k)] == [ok[j] for j in order]


def test_fuse_full_outer_and_threshold(spark):
    lex = spark.createDataFrame([(1, 10, 4.0), (1, 11, 0.1)], "query_id long, chunk_id long, rank_bm25 double")
    sem = spark.createDataFrame([(1, 11, 0.9), (1, 12, 0.95)], "query_id long, chunk_id long, rank_semantic double")
    got = {r.chunk_id: (r.rank_bm25, r.rank_semantic, r.final_rank) for r in fusion.fuse(lex, sem).collect()}
    assert got == {10: (4.0, 0.0, 1.2), 11: (0.1, 0.9, 0.93), 12: (0.0, 0.95, 0.95)}
    kept = fusion.fuse(lex, sem).where(F.col("final_rank") > 0.92)
    assert {r.chunk_id for r in kept.collect()} == {10, 11, 12}


def test_ann_recall_floor_and_exact_mode(spark):
    import numpy as np

    from ragloom.operators import ann, vector_search

    rng = np.random.default_rng(4)
    middles = rng.normal(size=(12, 8)) * 3
    x = np.concatenate([m + rng.normal(size=(60, 8)) for m in middles])
    ch = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)] + [(9000, None), (9001, [0.0] * 8)],
                               "chunk_id long, embedding array<double>")
    q = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x[::15] + 0.1)], "query_id long, query_vec array<double>")
    index, centers = ann.build_ivf(ch)
    index = ann.store_index(index)
    for k in (5, 100, 800):
        exact = vector_search.semantic_topk(ch, q, k, dim=8)
        key = lambda d: sorted((r.query_id, r["rank"], r.chunk_id, r.rank_semantic) for r in d.collect())
        assert key(ann.ann_topk(index, centers, q, k, n_probe=2, radius=ann.radii(index, len(centers)))) == key(exact)
        n = ann.probes_for(index, centers, exact, q, 0.9)
        got = ann.recall_vs_exact(ann.ann_topk(index, centers, q, k, n_probe=n), exact).first()
        assert got.recall >= 0.9 and (n < len(centers) or k > 5)


def test_many_queries_are_scored_in_bounded_parts(spark, monkeypatch):
    """However many queries match a batch of chunks, a task expands a bounded number of pairs and occurrences."""
    rnd = random.Random(3)
    vocab = [f"w{i}" for i in range(12)]
    texts = [(i, " ".join(rnd.choices(vocab, k=40))) for i in range(60)]
    asked = [(i, " ".join(rnd.sample(vocab, rnd.randint(1, 3)))) for i in range(150)]
    ch = spark.createDataFrame(texts, "chunk_id long, content string")
    q = spark.createDataFrame(asked, "query_id long, query_text string")
    qlex = lexical.query_lexemes(q)
    sets = lexical.lexeme_sets(qlex)
    table = lexical.SetTable(sets)
    assert sets.count() == 150 and len(table.set_id) < 150  # equal sets of words are scored once
    flat = [(c, w, p) for c, t in texts for p, w in enumerate(t.split(), 1)]
    chunk, pos = (np.array([f[i] for f in flat]) for i in (0, 2))
    code = table.vocab.get_indexer([f[1] for f in flat])
    keep = code >= 0
    widest = []
    plain = lexical._covers_sorted
    monkeypatch.setattr(lexical, "_covers_sorted", lambda *a: widest.append(len(a[2])) or plain(*a))
    whole = {}
    for most in (1 << 19, 200):
        monkeypatch.setattr(lexical, "EXPANDED", most)
        widest.clear()
        whole[most] = {(int(table.set_id[s]), int(c)): r for part in lexical.score_sets(table, chunk[keep], code[keep], pos[keep]) for s, c, r in zip(*part)}
        assert max(widest) <= most
    assert len(widest) > 10 and whole[200] == whole[1 << 19]
    for (s, c), r in whole[200].items():
        assert abs(r - brute_cover_density(texts[c][1].split(), dict(asked)[s].split())) < 1e-9
    # cutting a task's matches to the k best as they come changes no top
    cols = ("query_id", "chunk_id", "rank_bm25", "rank")
    rows = lambda d: sorted(tuple(r[x] for x in cols) for r in d.collect())
    assert rows(lexical.lexical_topk(ch, q, 7)) == rows(lexical.lexical_topk(ch, q, 7, broadcast_limit_bytes=10))
    parts = [tuple(np.array(x) for x in zip(*[(s, c, r)])) for (s, c), r in whole[200].items()]
    cut = [tuple(x) for p in lexical.best_of_task(iter(parts), 3, most=50) for x in zip(*p)]
    for s in {k[0] for k in whole[200]}:
        order = lambda x: (-round(x[1], 9), x[0])
        best = sorted(((c, r) for (t, c), r in whole[200].items() if t == s), key=order)[:3]
        assert sorted(((c, r) for t, c, r in cut if t == s), key=order)[:3] == best


def test_a_stored_list_is_few_files(spark):
    from ragloom.operators import ann

    rows = [(i, i % 2, 0.0, [float(i), 1.0]) for i in range(64)]
    index = spark.createDataFrame(rows, "chunk_id long, list_id long, distance double, vec array<double>").repartition(16)
    stored = ann.store_index(index)
    assert len(stored.inputFiles()) <= 2 * ann.FILES_OF_LIST  # not one for each task that assigned rows
    assert sorted(r.chunk_id for r in stored.collect()) == list(range(64))


def test_content_fusion_joins_without_texts(spark):
    from itertools import product

    chunks = [(1, "s", 1, "same"), (2, "s", 1, "same"), (3, "s", 2, "same"), (4, "t", 1, None), (5, None, 1, "other"), (6, "s", 3, ""),
              (7, "s", 4, "Text"), (7, "s", 5, "twice the id")]
    hits = [(q, c) for q in (1, 2) for c in range(1, 8)]
    lex_rows = [(q, c, float(q + c), 1) for q, c in hits if (q + c) % 3]
    sem_rows = [(q, c, float(q * c) / 16, 1) for q, c in hits if (q * c) % 4]
    ch = spark.createDataFrame(chunks, "chunk_id long, source string, page_number long, content string")
    lex = spark.createDataFrame(lex_rows, "query_id long, chunk_id long, rank_bm25 double, rank long")
    sem = spark.createDataFrame(sem_rows, "query_id long, chunk_id long, rank_semantic double, rank long")
    left, right = ([(q, s, t, p, r) for q, c, r, _ in rows for i, s, p, t in chunks if i == c] for rows in (lex_rows, sem_rows))
    meets = lambda a, b: a[:4] == b[:4] and None not in a[:4]
    want = [(*a[:4], a[4], b[4]) for a, b in product(left, right) if meets(a, b)]
    want += [(*a, 0.0) for a in left if not any(meets(a, b) for b in right)] + [(*b[:4], 0.0, b[4]) for b in right if not any(meets(a, b) for a in left)]
    for shown, of in ((None, lambda t: t), (F.upper("content"), lambda t: t and t.upper())):
        out = fusion.fuse_by_content(lex, sem, ch, shown=shown)
        assert out.columns == ["query_id", "source", "content", "page_number", "rank_bm25", "rank_semantic", "final_rank"]
        assert sorted((tuple(r)[:6] for r in out.collect()), key=str) == sorted(((q, s, of(t), *rest) for q, s, t, *rest in want), key=str)
    # texts are no join key, so no hit carries one through an exchange
    joins = [x for x in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in x]
    assert joins and not any("content#" in x for x in joins) and any("_digest#" in x for x in joins)
