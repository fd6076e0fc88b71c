"""The stored text index and stems, against the scan of texts, plain loops and hand-written pairs."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ragloom.operators import ingest, lexical, stemming, text_index
from tests.test_search import brute_cover_density

VOCAB = ["alpha", "beta", "gamma", "delta", "eps"]


def _texts(seed, n, lo=-40):
    rnd = random.Random(seed)
    return [(lo + i, " ".join(rnd.choices(VOCAB, weights=[9, 5, 3, 2, 1], k=rnd.randint(1, 30)))) for i in range(n)]


def _queries(spark, texts=("alpha", "beta gamma", "eps alpha delta", "delta", "", "nowhere alpha", "gamma alpha beta delta eps")):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, query_text string")


def _rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def _build(ch, tmp_path, name="ix", **kw):
    text_index.write_epoch(ch, str(tmp_path / name), **kw)
    return text_index.read(ch.sparkSession, str(tmp_path / name))


def test_index_matches_equal_brute_force_and_the_scan(spark, tmp_path):
    rows = _texts(1, 120) + [(500, None), (501, ""), (502, " .,; "), (None, "alpha beta")]
    rows += rows[:5]  # repeated rows count once
    rows.append((9_000_000_000, "alpha " * 3000 + "eps delta"))  # one long text, far from the others
    ch = spark.createDataFrame(rows, "chunk_id long, content string").repartition(3)
    q = _queries(spark)
    index = _build(ch, tmp_path, block_ids=8)
    expect = {}
    for r in q.collect():
        lex = r.query_text.split()
        for cid, text in dict(rows).items():
            if cid is not None and text and cid != 9_000_000_000:
                s = brute_cover_density(text.split(), lex)
                if s is not None:
                    expect[(r.query_id, cid)] = s
    for limit in (None, 0):  # small sides broadcast, then shuffled
        got = {(r.query_id, r.chunk_id): r.rank_bm25 for r in text_index.lexical_match(index, q, block_ids=8, limit=limit).collect()}
        far = {k: v for k, v in got.items() if k[1] == 9_000_000_000}
        assert far[(0, 9_000_000_000)] == 300.0 and set(far) == {(0, 9_000_000_000), (2, 9_000_000_000), (3, 9_000_000_000)}
        assert {k for k in got if k not in far} == expect.keys()
        assert all(abs(got[k] - v) < 1e-9 for k, v in expect.items())
    key = lambda d: sorted(tuple(map(str, r)) for r in d.select("tok", "block", "n_chunks", "max_tf", "id_gap", "pos_gap").collect())
    assert key(text_index.encode_texts(ch, 8)) == key(text_index.encode(lexical.postings(ch), 8)) == key(index)
    scan = lexical.lexical_match(ch.where("chunk_id is not null").distinct(), q)
    cols = ("query_id", "chunk_id", "rank_bm25")
    assert _rows(text_index.lexical_match(index, q, block_ids=8), *cols) == _rows(scan, *cols)


def test_no_chunk_beats_its_blocks_bound(spark, tmp_path):
    ch = spark.createDataFrame(_texts(2, 300, lo=0), "chunk_id long, content string")
    q = _queries(spark)
    index = _build(ch, tmp_path, block_ids=4)
    reach = {(r.query_id, r.block): r.reach for r in text_index.candidate_blocks(index, lexical.query_lexemes(q)).collect()}
    found = text_index.lexical_match(index, q, block_ids=4).collect()
    assert found
    for r in found:
        assert r.rank_bm25 <= 0.1 * reach[(r.query_id, r.chunk_id // 4)] + 1e-9


@pytest.mark.parametrize("k", [1, 3, 1000])
def test_top_k_is_exact_and_leaves_blocks_unread(spark, tmp_path, k):
    rows = _texts(3, 400, lo=0) + [(10_000 + i, "alpha beta") for i in range(50)]  # many ties
    rows += [(20_000 + i, "alpha " * 40 + "beta gamma delta eps") for i in range(6)]  # few blocks lead
    ch = spark.createDataFrame(rows, "chunk_id long, content string")
    q = _queries(spark)
    index = _build(ch, tmp_path, block_ids=4)
    top, reads = text_index.topk_and_reads(index, q, k, block_ids=4, first=2, grow=2, rounds=2)
    cols = ("query_id", "rank", "chunk_id", "rank_bm25")
    assert _rows(top, *cols) == _rows(lexical.lexical_topk(ch, q, k), *cols)
    n = {r.query_id: (r.n_read, r.n_blocks) for r in reads.collect()}
    assert all(a <= b for a, b in n.values())
    if k < 1000:
        assert n[0][0] < n[0][1] / 2  # one word: the bound is the rank itself


def test_epochs_extend_replay_and_reset(spark, tmp_path):
    rows = _texts(4, 60, lo=0)
    ch = spark.createDataFrame(rows, "chunk_id long, content string")
    q = _queries(spark)
    cols = ("query_id", "chunk_id", "rank_bm25")
    whole = _rows(text_index.lexical_match(_build(ch, tmp_path, "one"), q), *cols)
    path = str(tmp_path / "parts")
    for epoch, part in (("a", "chunk_id < 25"), ("b", "chunk_id >= 25"), ("b", "chunk_id >= 25")):
        text_index.write_epoch(ch.where(part), path, epoch)
    index = text_index.read(spark, path)
    assert index.select("epoch").distinct().count() == 2
    assert _rows(text_index.lexical_match(index, q), *cols) == whole
    assert _rows(text_index.lexical_topk(index, q, 7), *cols) == _rows(lexical.lexical_topk(ch, q, 7), *cols)

    table = ch.select("chunk_id", "content", F.lit(None).cast("array<float>").alias("embedding"), F.lit("f").alias("source"),
                      F.lit(1).cast("long").alias("page_number"), F.lit("English").alias("language"), F.lit("h").alias("hash_value"),
                      F.lit("recursive").alias("strategy"))
    chunks, ix = str(tmp_path / "chunks"), str(tmp_path / "ix")
    ingest.create_table(spark, chunks)
    text_index.write_with_chunks(table.where("chunk_id < 25"), chunks, ix, True, "recursive", "1")
    text_index.write_with_chunks(table.where("chunk_id >= 25"), chunks, ix, False, "recursive", "2")
    assert spark.read.parquet(chunks).count() == 60
    assert _rows(text_index.lexical_match(text_index.read(spark, f"{ix}/strategy=recursive"), q), *cols) == whole
    text_index.write_with_chunks(table.limit(0), chunks, ix, True, "recursive")
    index = text_index.read(spark, f"{ix}/strategy=recursive")
    assert index.count() == 0 and text_index.lexical_topk(index, q).count() == 0


def test_empty_tables_and_clashing_columns(spark, tmp_path):
    none = spark.createDataFrame([], "chunk_id long, content string")
    q = _queries(spark)
    assert text_index.lexical_match(_build(none, tmp_path, "none"), q).count() == 0
    ch = spark.createDataFrame([(1, "alpha beta", "x", 5, 7)], "chunk_id long, content string, tok string, block int, pos int")
    index = _build(ch, tmp_path)
    assert [(r.query_id, r.chunk_id) for r in text_index.lexical_topk(index, q).collect()] == [(0, 1)]
    assert text_index.lexical_topk(index, q.limit(0)).count() == 0


def test_stem_pairs_per_configuration(spark):
    same = {
        "English": [("houses", "house"), ("cities", "city"), ("walking", "walked"), ("boxes", "box"), ("classes", "class"), ("quickly", "quick")],
        "French": [("maisons", "maison"), ("chevaux", "cheval"), ("nations", "nation"), ("grandes", "grande")],
        "German": [("frauen", "frau"), ("kinder", "kindes"), ("wohnungen", "wohnung"), ("lehrerinnen", "lehrer")],
        "Spanish": [("casas", "casa"), ("luces", "luz"), ("naciones", "nacion"), ("hablando", "hablado")],
        "Italian": [("libri", "libro"), ("nazione", "nazioni")],
        "Portuguese": [("livros", "livro"), ("nacoes", "nacao")],
        "Dutch": [("boeken", "boek"), ("waarheden", "waarheid")],
    }
    apart = [("English", "news", "newer"), ("English", "bus", "bush"), ("Spanish", "casa", "cosa"), ("Polish", "domy", "dom")]
    toks = {(c, w) for c, ps in same.items() for p in ps for w in p} | {(c, w) for c, a, b in apart for w in (a, b)}
    toks |= {("English", "s"), ("English", ""), (None, "houses"), ("simple", "houses"), ("English", "glass")}
    vocab = spark.createDataFrame(sorted(toks, key=str), "config string, tok string")
    stem = {(r.config, r.tok): r.stem for r in stemming.dictionary(vocab).collect()}
    of = lambda c, w: stem.get((c, w), w)
    for c, pairs in same.items():
        for a, b in pairs:
            assert of(c, a) == of(c, b), (c, a, b, of(c, a), of(c, b))
    for c, a, b in apart:
        assert of(c, a) != of(c, b)
    assert of(None, "houses") == of("simple", "houses") == "houses" and of("English", "s") == "s" and of("English", "glass") == "glass"


def test_stems_and_a_hook_decide_matches(spark, tmp_path):
    ch = spark.createDataFrame([(1, "the houses near rivers", "English"), (2, "a house by the river", "English"),
                                (3, "houses rivers", "simple"), (4, None, "English"), (5, "houses", None)],
                               "chunk_id long, content string, config string")
    q = spark.createDataFrame([(1, "house rivers", "English")], "query_id long, query_text string, config string")
    vocab = stemming.vocabulary(ch, "content").union(stemming.vocabulary(q, "query_text", fold_accents=False)).distinct()

    def first_five(config: str, toks: pd.Series) -> pd.Series:
        return toks.str[:5] if config == "English" else toks

    for name, stems in (("rules", stemming.dictionary(vocab)), ("hook", stemming.hook(vocab, first_five))):
        index = _build(ch, tmp_path, name, config_col="config", stems=stems)
        hits = text_index.lexical_match(index, q, query_config_col="config", stems=stems)
        assert {r.chunk_id for r in hits.collect()} == {1, 2}, name
    plain = _build(ch, tmp_path, "plain", config_col="config")
    assert text_index.lexical_match(plain, q, query_config_col="config").count() == 0
    with pytest.raises(ValueError):
        text_index.write_epoch(ch, str(tmp_path / "x"), stems=stemming.dictionary(vocab))


def test_a_vocabulary_splits_each_text_once(spark):
    texts = spark.createDataFrame([("English", "on and on"), (None, "on"), ("English", None), ("English", " . ")], "config string, content string")
    vocab = stemming.vocabulary(texts, "content")
    assert sorted(vocab.collect(), key=str) == sorted([("English", "on"), ("English", "and"), (None, "on")], key=str)
    plan = vocab._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and "array_distinct" in plan  # a text's words combine in it


def test_index_by_configuration_and_stems_exchanges_texts_not_postings(spark, tmp_path, monkeypatch):
    from ragloom.operators import stopwords

    words = ["the", "running", "runs", "run", "und", "laufen", "boxes", "box", "le", "chats"]
    rnd = random.Random(7)
    rows = [(i - 20, rnd.choice(["English", "German", "French", "simple", None]), " ".join(rnd.choices(words, k=rnd.randint(0, 25)))) for i in range(90)]
    rows += rows[:4] + [(3, "English", "runs the box " * 9), (None, "English", "run"), (200, "German", None), (201, "English", "the the")]
    ch = spark.createDataFrame(rows, "chunk_id long, config string, content string").repartition(4)
    stems = stemming.dictionary(stemming.vocabulary(ch, "content"))
    key = lambda d: sorted(tuple(map(str, r)) for r in d.select("tok", "block", "n_chunks", "max_tf", "id_gap", "pos_gap").collect())
    want = [key(text_index.encode(stopwords.config_postings(ch, stems=s), 8)) for s in (None, stems)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")  # blocks go on in the next batch
    try:
        assert [key(text_index.encode_texts(ch, 8, config_col="config", stems=s)) for s in (None, stems)] == want
        with monkeypatch.context() as m:
            m.setattr(text_index, "encode", lambda *a, **k: pytest.fail("postings are exchanged"))
            assert key(_build(ch, tmp_path, "small", block_ids=8, config_col="config", stems=stems)) == want[1]
        monkeypatch.setattr(text_index.sizing, "broadcast_limit", lambda df, limit=None: 0)  # a dictionary too large to broadcast
        assert key(_build(ch, tmp_path, "large", block_ids=8, config_col="config", stems=stems)) == want[1]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_stored_tables_leave_no_shuffle_files_or_tables_behind(spark):
    import os
    import time

    from ragloom.operators import sizing

    inner = []

    def make():
        inner.append(sizing.materialize(spark.range(0, 3000, 1, 3).repartition(5, "id")))
        return inner[0].groupBy((F.col("id") % 7).alias("k")).count()

    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f for f in (str(manager.getAllFiles().apply(i)) for i in range(manager.getAllFiles().size())) if "shuffle_" in f}
    before = files()
    out = sizing.stored(spark, make)
    assert sorted((r.k, r["count"]) for r in out.collect()) == [(k, len(range(k, 3000, 7))) for k in range(7)]
    paths = {f.rsplit("/", 1)[0].removeprefix("file:") for f in inner[0].inputFiles()}
    assert paths and not any(os.path.exists(p) for p in paths)
    for _ in range(50):  # files are deleted in the background
        if not files() - before:
            break
        time.sleep(0.2)
    assert not files() - before
