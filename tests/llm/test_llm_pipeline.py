"""The pipeline on small tables with planted cases, and the registered names."""

import random
import re
import zlib

import numpy as np

import __spark_entry__ as entry
import corpus_pipeline


def tables(spark, folder, n=700):
    rng = random.Random(2)
    bad = [f"vile{c}" for c in "abcdefgh"]
    text = lambda k: " ".join(f"w{rng.randrange(500)}" for _ in range(k))
    items = [(i, text(30)) for i in range(5)]
    docs, labels, kinds = [], [], {}
    for i in range(n):
        kinds[i] = rng.choice(["plain"] * 5 + ["toxic", "copy", "bench", "pii"]) if i > 10 else "plain"
        t = text(rng.randint(30, 200))
        if kinds[i] == "toxic":
            t = " ".join([*rng.choices(bad, k=4), t])
        if kinds[i] == "copy":
            t = docs[i % 10][1]
        if kinds[i] == "bench":
            t = items[i % 5][1] + " " + t[:200]
        if kinds[i] == "pii":
            t += f" mail me{i}@site.org or +1 (212) 555-{1000 + i} end"
        docs.append((i, t, "en", f"src{i % 3}", len(t)))
        labels.append((i, 1, int(kinds[i] == "toxic")))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return kinds


def test_stages_take_effect_and_keep_clean_documents(spark, tmp_path):
    kinds = tables(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, left = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/out-{name}")
        docs = spark.read.parquet(f"{tmp_path}/out-{name}")
        left[name] = docs
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    ids = {n: {r.doc_id for r in d.select("doc_id").collect()} for n, d in left.items()}
    of = lambda k: {i for i, x in kinds.items() if x == k}
    assert len(of("toxic") & ids["toxicity"]) <= 0.1 * len(of("toxic"))
    assert len(of("plain") - ids["toxicity"]) <= 0.02 * len(of("plain"))
    assert not of("copy") & ids["simhash_near_dedup"] and ids["toxicity"] - of("copy") <= ids["simhash_near_dedup"]
    assert not of("bench") & ids["benchmark_decontamination"]
    assert ids["simhash_near_dedup"] - of("bench") == ids["benchmark_decontamination"] == ids["pii"]
    for r in left["pii"].collect():
        assert not re.search(r"@site|555-", r.text) and r.n_chars == len(r.text)
        assert ("[EMAIL]" in r.text) == (kinds[r.doc_id] == "pii") == ("[PHONE]" in r.text)
    assert ids["best_fit_packing"] == ids["pii"]
    whole = corpus_pipeline.run(spark, str(tmp_path))
    key = lambda d: sorted((r.doc_id, r.piece, r.ids_crc32, r.length) for r in d.collect())
    assert key(whole) == key(left["best_fit_packing"])


def test_stages_on_nulls_empty_long_and_repeated_rows(spark, tmp_path):
    tables(spark, str(tmp_path), 120)
    long_ = " ".join(f"l{i}" for i in range(30000))
    rows = [(1000, None, "en", "s", 0, 1), (1001, "", "en", "s", 0, 2), (None, "a text whose id is null and more", None, None, None, 3),
            (1002, long_, "en", "s", 1, 4), (1003, "one row that comes twice here", "en", "s", 5, 5), (1003, "one row that comes twice here", "en", "s", 5, 5)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _score long"
    docs = spark.createDataFrame(rows, schema).unionByName(
        spark.read.parquet(f"{tmp_path}/documents.parquet").selectExpr("*", "0L AS _score"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/edge-{name}")
        docs = spark.read.parquet(f"{tmp_path}/edge-{name}")
        seen[name] = [r.doc_id for r in docs.select("doc_id").collect()]
        if name != "best_fit_packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "_score"]
    assert seen["toxicity"].count(1003) == 2 and {1000, 1001, 1002, None} <= set(seen["toxicity"])
    near = seen["simhash_near_dedup"]
    assert near.count(1003) == 1 and near.count(1000) == 1 and 1001 not in near and {None, 1002} <= set(near)  # no words: one group
    assert seen["benchmark_decontamination"].count(1000) == seen["pii"].count(1000) == seen["best_fit_packing"].count(1000) == 1
    assert seen["best_fit_packing"].count(1002) > 10  # cut into pieces
    empty = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_held_out_toxicity_on_the_given_tables(spark):
    rows = entry.queries()["op9_toxicity"](spark, "/root/testdata/sf0.1").join(
        spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out").select("doc_id", "toxic", "score").collect()
    assert rows and all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    y, s = np.array([r.toxic for r in rows]), np.array([r.score for r in rows])
    order = s.argsort().argsort()
    auc = (order[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() - 1) / 2) / ((y == 1).sum() * (y == 0).sum())
    assert auc > 0.95, auc


def test_all_operators_are_registered():
    names = set(entry.queries())
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)) and "pipeline" in names
    assert len(corpus_pipeline.STAGES) == 5
