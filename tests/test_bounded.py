"""Memory, disk and tasks that must not grow with a batch, a text or a block."""

import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from conftest import SF001

from ragloom.operators import clustering as K
from ragloom.operators import embedding, ingest, metrics as M, rerank


def peak_mb(fn):
    tracemalloc.start()
    out = fn()
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return out, most


def test_resampling_hashes_once_and_is_spread_over_tasks(spark):
    scores = spark.range(100).selectExpr("id AS qid", "id / 100 AS f").coalesce(1)
    plan = M.resampled(scores, "qid", ["f"], replicates=5)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") == 1
    assert "Repartition" in plan


def test_greedy_match_of_long_texts_is_bounded():
    a, b = [f"left{i}" for i in range(4000)], [f"right{i}" for i in range(4000)]
    M._trigram_vec.cache_clear()
    _, most = peak_mb(lambda: M._greedy(a, b, 64))
    assert most < 60  # all similarities at once are 128 MB
    x, y = ["aa", "bb", "aa", "cc"], ["bb", "dd"]
    s = np.array([[M._trigram_vec(p, 64) @ M._trigram_vec(q, 64) for q in y] for p in x])
    np.testing.assert_allclose(M._greedy(x, y, 64), (s.max(axis=1).mean(), s.max(axis=0).mean()))


def test_token_pairs_come_in_pieces(monkeypatch):
    monkeypatch.setattr(M, "AT_ONCE", 3)
    a, b = pa.array([["x", "y"], None, [], ["z"] * 9]), pa.array([["x"], ["q"], None, ["z"]])
    assert list(M._token_pairs(a, b)) == [(["x", "y"], ["x"]), ([], ["q"]), ([], []), (["z"] * 9, ["z"])]


def test_hashed_vectors_of_a_large_batch_are_bounded():
    sizes = np.full(4000, 1000)
    values = pa.array(np.arange(sizes.sum(), dtype=np.int32) % 64)
    rows = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), values)
    _, most = peak_mb(lambda: embedding._counted(rows, 64, np.float64))
    assert most < 40  # places of all tokens at once are 32 MB, twice
    few = embedding._counted(pa.array([[0, 0, 1], None, [], [3]], pa.list_(pa.int32())), 4, np.float32)
    assert few.type.value_type == pa.float32() and few[1].as_py() is None and few[2].as_py() is None
    np.testing.assert_allclose(few[0].as_py(), np.array([2, 1, 0, 0]) / np.sqrt(5))


def test_neighbours_of_a_block_are_bounded():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1024, 64))
    pdf = pd.DataFrame({"side": np.repeat([0, 1], 1024), "id": np.tile(np.arange(1024), 2), "vec": list(x) * 2})
    out, most = peak_mb(lambda: K._knn_block(2, "id", "vec")(pdf))
    assert most < 60  # differences of 2 ** 24 values are 134 MB, and so are their squares
    d = np.sqrt(((x[:50, None, :] - x[None, :, :]) ** 2).sum(axis=2))
    d[np.arange(50), np.arange(50)] = np.inf
    want = {(i, int(j)) for i in range(50) for j in np.argsort(d[i])[:2]}
    assert {(i, j) for i, j in zip(out["id"], out["nbr"]) if i < 50} == want


def test_appended_chunks_go_to_their_folder_unsorted_and_small(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"text {i}", "first") for i in range(10)], "chunk_id long, content string, strategy string")
    path = str(tmp_path / "table")
    ingest.write_chunks(rows, path, False, strategy="first")
    ingest.write_chunks(rows, path, False, strategy="first")
    ingest.write_chunks(rows, path, False, strategy="second")  # none of it
    table = spark.read.parquet(path)
    assert [tuple(r) for r in table.groupBy("strategy").count().collect()] == [("first", 20)]
    files = list((tmp_path / "table" / "strategy=first").glob("part-*.parquet"))
    assert {pq.ParquetFile(f).metadata.row_group(0).column(0).compression for f in files} == {"ZSTD"}


def test_a_chunks_tokens_are_joined_last(spark):
    hits = spark.createDataFrame([(1, 7, "a b", 1), (1, 8, "c", 2)], "query_id long, chunk_id long, content string, rank int")
    q = spark.createDataFrame([(1, "b")], "query_id long, query_text string")
    out = rerank.rerank(hits, q)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join Inner, (chunk_id") < plan.index("Join Inner, (query_id")
    assert [(r.chunk_id, r.score, r.rerank) for r in out.orderBy("rerank").collect()] == [(7, 1.0, 1), (8, 0.0, 2)]


def test_clusters_are_joined_without_texts(spark):
    from ragloom.plans import clusters

    assert "content" not in clusters._cluster_hits(spark, SF001)[1].columns
