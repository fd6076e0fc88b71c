"""Ingest (reset/append, load-once), skew-safe numbering, driver contract."""

import os
import tempfile

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ragloom.functions import text as T
from ragloom.operators import ingest
from ragloom.operators.ranking import row_number_in_groups


def _chunks(spark, names):
    rows = [(i, f"text {i}", [0.1, 0.2], n, 1, "en") for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "chunk_id long, content string, embedding array<float>, source string, "
                                       "page_number long, language string")


def test_reset_and_append(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="ragloom-test-"), "chunks")
    ingest.create_table(spark, path)
    rows = ingest.chunk_rows(_chunks(spark, ["a.pdf", "b.pdf"]), "recursive")
    ingest.write_chunks(rows, path, reset=False)
    ingest.write_chunks(rows, path, reset=False)
    assert spark.read.parquet(path).count() == 4
    ingest.write_chunks(rows, path, reset=True)
    assert spark.read.parquet(path).count() == 2
    # resetting one strategy leaves the others, and creating the table again leaves all
    ingest.write_chunks(ingest.chunk_rows(_chunks(spark, ["a.pdf"]), "semantic"), path, reset=True)
    ingest.write_chunks(ingest.chunk_rows(_chunks(spark, ["c.pdf"]), "recursive"), path, reset=True)
    ingest.create_table(spark, path)
    counts = {r.strategy: r["count"] for r in spark.read.parquet(path).groupBy("strategy").count().collect()}
    assert counts == {"recursive": 1, "semantic": 1}


def test_load_once_by_cleaned_name(spark):
    table = ingest.chunk_rows(_chunks(spark, ["a(1).pdf"]), "recursive")
    batch = spark.createDataFrame([("a1.pdf",), ("b.pdf",), ("b.pdf",), ("[b].pdf",)], "file_name string")
    flags = {r.file_name: r.loaded for r in ingest.already_loaded(batch, table).collect()}
    assert flags["a1.pdf"] is True and flags["b.pdf"] is False
    fresh = ingest.new_files_only(batch, table).collect()
    assert [r.file_name for r in fresh] == ["[b].pdf"]  # one row per cleaned name, the smallest name kept
    rep = {r.status: r.n_files for r in ingest.ingest_report(batch, table).collect()}
    assert rep == {"rejected": 1, "processed": 3}
    bad = spark.createDataFrame([("b.pdf",)], "file_name string")
    status = sorted((r.file_name, r.status) for r in ingest.file_status(batch, table, failed=bad).collect())
    assert status == [("[b].pdf", "processed"), ("a1.pdf", "rejected"), ("b.pdf", "failed"), ("b.pdf", "failed")]


def test_row_number_in_groups_matches_window(spark):
    df = spark.range(0, 5000).select((F.when(F.col("id") % 10 < 7, 0).otherwise(F.col("id") % 10)).alias("g"),
                                     (F.col("id") * 7919 % 10007).alias("k"))
    mine = row_number_in_groups(df, "g", "k", n_parts=13)
    ref = df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("k")))
    a = {(r.g, r.k): r.row_number for r in mine.collect()}
    b = {(r.g, r.k): r.rn for r in ref.collect()}
    assert a == b


def test_width_check_raises(spark):
    df = spark.createDataFrame([("s", "h", [1.0, 2.0])], "source string, hash_value string, embedding array<float>")
    try:
        ingest.embeddings_by_source(df, dim=3).collect()
    except Exception as e:  # noqa: BLE001
        assert "Embedding size mismatch" in str(e)
    else:
        raise AssertionError("expected a width error")


def test_entry_and_registry(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())
    assert {"query_id", "rank", "chunk_id", "final_rank"} <= set(df.columns)


def test_reset_by_name_and_checks_by_strategy(spark, tmp_path):
    path = str(tmp_path / "t")
    row = lambda i, s: (i, "x", None, f"f{i}.pdf", 1, "English", ingest_hash(i), s)
    ingest_hash = lambda i: spark.range(1).select(T.file_hash(F.lit(f"f{i}.pdf"))).first()[0]
    table = lambda rows: spark.createDataFrame(rows, ingest.CHUNK_SCHEMA)
    ingest.write_chunks(table([row(1, "a"), row(2, "b")]), path, False)
    ingest.write_chunks(table([row(3, "a"), row(4, "b")]), path, True, strategy="a")
    read = lambda: spark.read.schema(ingest.CHUNK_SCHEMA).parquet(path)
    assert sorted((r.chunk_id, r.strategy) for r in read().collect()) == [(2, "b"), (3, "a")]
    files = spark.createDataFrame([("f2.pdf",), ("f3.pdf",)], "file_name string")
    loaded = lambda s: {r.file_name: r.loaded for r in ingest.already_loaded(files, read(), strategy=s).collect()}
    assert loaded(None) == {"f2.pdf": True, "f3.pdf": True} and loaded("a") == {"f2.pdf": False, "f3.pdf": True}
    assert [r.file_name for r in ingest.new_files_only(files, read(), strategy="b").collect()] == ["f3.pdf"]
    assert {r.status: r.n_files for r in ingest.ingest_report(files, read(), strategy="c").collect()} == {"processed": 2}
    ingest.write_chunks(table([]), path, True, strategy="b")
    assert [(r.chunk_id, r.strategy) for r in read().collect()] == [(3, "a")]
    with pytest.raises(ValueError):
        ingest.write_chunks(table([]), path, True, strategy="../b")
