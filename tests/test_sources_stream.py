"""Sources (file listing, form-feed pages) and the streaming ingest's load-once property."""

import os
import shutil
import tempfile

import pytest

from ragloom.sources.tables import list_files, load_qa, page_files, page_table
from ragloom.streaming import ingest_stream as stream
from ragloom.streaming.ingest_stream import run_twice

from conftest import SF001


def test_list_files_pdf_only_not_recursive(spark):
    d = tempfile.mkdtemp(prefix="ragloom-files-")
    for name in ("a.pdf", "b.PDF", "c.txt", "Doc [x], (v1).pdf"):
        with open(os.path.join(d, name), "wb") as f:
            f.write(b"%PDF-1.4 test")
    os.makedirs(os.path.join(d, "sub"))
    with open(os.path.join(d, "sub", "d.pdf"), "wb") as f:
        f.write(b"x")
    got = sorted(r.source for r in list_files(spark, d).collect())
    assert got == ["Doc [x], (v1).pdf", "a.pdf"]
    with pytest.raises(Exception):
        list_files(spark, os.path.join(d, "missing")).collect()


def test_form_feed_pages_keep_gaps(spark):
    df = spark.createDataFrame([("f.pdf", "one\fthree   \f \ffour")], "source string, text string")
    rows = page_table(df, page_mark="\f").orderBy("page_number").collect()
    assert [(r.page_number, r.text) for r in rows] == [(1, "one"), (2, "three   "), (4, "four")]


def test_pages_with_null_and_repeated_keys_all_stay(spark):
    rows = [("a", 1, "x"), ("a", 1, "y"), ("a", 1, "y"), ("a", None, "first"), ("a", 2, " "), ("a", 3, "last"), (None, 1, "n1"), (None, None, "n0")]
    got = page_table(spark.createDataFrame(rows, "source string, k int, text string").repartition(3), order_col="k").collect()
    assert sorted((r.source or "", r.page_number) for r in got) == [("", 1), ("", 2), *[("a", i) for i in (1, 2, 3, 4, 6)]]
    by = {(r.source, r.page_number): r.text for r in got}
    assert by["a", 1] == "first" and by["a", 6] == "last" and by[None, 1] == "n0" and sorted(by["a", i] for i in (2, 3, 4)) == ["x", "y", "y"]


def test_load_qa_requires_columns(spark):
    with pytest.raises(ValueError):
        load_qa(spark.createDataFrame([("q",)], "QUERY string"))
    assert load_qa(spark.createDataFrame([("q", "a")], "QUERY string, ANSWER string")).columns == ["question", "answer"]


def _ingested(spark, folder, glob, **kw):
    table = run_twice(spark, folder, glob, **kw)
    return sorted((r.strategy, r.source, r.page_number, r.chunk_index, r.content) for r in table.collect())


def test_streaming_ingest_does_not_depend_on_the_files(spark, tmp_path):
    docs = spark.read.parquet(os.path.join(SF001, "documents.parquet"))
    docs.repartition(4).write.parquet(str(tmp_path / "four"))  # pages of a document lie in several files
    one = _ingested(spark, SF001, "documents.parquet")
    four = _ingested(spark, str(tmp_path / "four"), "*.parquet")
    assert one == four
    assert len({(r[1], r[2]) for r in one}) == docs.where("trim(text) != ''").count()
    assert {r[1] for r in one} == {f"{r.source}.pdf" for r in docs.select("source").distinct().collect()}
    assert all(len(r[4]) <= 512 for r in one)


def test_a_failed_batch_replays_and_strategies_coexist(spark, tmp_path):
    pages = [("a.pdf", i, f"page {i} " * 200, "en") for i in range(4)] + [("b.pdf", 0, " ", "en"), ("b.pdf", 1, "text", "en")]
    batch = spark.createDataFrame(pages, "file_name string, page_key long, text string, lang string")
    table = str(tmp_path / "table")
    stream.process_batch(batch, table, "recursive", epoch="e0")
    whole = sorted(map(tuple, stream.read_table(spark, table).drop("embedding").collect()), key=str)
    shutil.rmtree(f"{table}/pages")  # the ledger of the batch was not written: nothing of it counts
    assert stream.read_table(spark, table).count() == 0
    stream.process_batch(batch, table, "recursive", epoch="e0")
    stream.process_batch(batch, table, "recursive", epoch="e1")
    assert sorted(map(tuple, stream.read_table(spark, table).drop("embedding").collect()), key=str) == whole
    assert {r.page_number for r in stream.read_table(spark, table).where("source = 'b.pdf'").collect()} == {2}
    stream.process_batch(batch, table, "semantic", epoch="e2")
    counts = {r.strategy: r["count"] for r in stream.read_table(spark, table).groupBy("strategy").count().collect()}
    assert counts == {"recursive": len(whole), "semantic": len(whole)}
    with pytest.raises(Exception):  # a broken table isn't an empty one
        (tmp_path / "bad" / "pages").mkdir(parents=True)
        (tmp_path / "bad" / "pages" / "x.parquet").write_bytes(b"broken")
        stream.process_batch(batch, str(tmp_path / "bad"), epoch="e0")


def _pages(spark, names, keys=range(3)):
    rows = [(n, i, f"page {i} of {n}", "en") for n in names for i in keys]
    return spark.createDataFrame(rows, "file_name string, page_key long, text string, lang string")


def _bucket(spark, name):
    return _pages(spark, [name], [0]).select(stream.T.file_hash("file_name").alias("h")).first().h[:stream.PREFIX]


def test_a_batch_reads_no_other_documents_ledger(spark, tmp_path):
    table = str(tmp_path / "table")
    names = [f"d{i}.pdf" for i in range(4)]
    stream.process_batch(_pages(spark, names), table, epoch="e0")
    other = next(n for n in (f"x{i}.pdf" for i in range(9)) if _bucket(spark, n) not in {_bucket(spark, m) for m in names})
    spoiled = tmp_path / "table" / "pages" / "strategy=recursive" / f"bucket={_bucket(spark, other)}" / "part=bad"
    spoiled.mkdir(parents=True)
    (spoiled / "x.parquet").write_bytes(b"broken")
    stream.process_batch(_pages(spark, names, range(5)), table, epoch="e1")  # doesn't touch it
    with pytest.raises(Exception):
        stream.process_batch(_pages(spark, [other]), table, epoch="e2")
    shutil.rmtree(spoiled.parent)
    got = {(r.source, r.page_number, r.content) for r in stream.read_table(spark, table).collect()}
    assert got == {(n, i + 1, f"page {i} of {n}") for n in names for i in range(5)}


def test_joined_parts_hold_the_same_ledger(spark, tmp_path):
    table = str(tmp_path / "table")
    for e in range(4):
        stream.process_batch(_pages(spark, ["a.pdf", "b.pdf"], range(e * 2, e * 2 + 3)), table, epoch=f"e{e}")
    rows = lambda: sorted(map(tuple, stream.read_table(spark, table).drop("embedding").collect()), key=str)
    whole, kept = rows(), str(tmp_path / "kept")
    assert len(whole) == 2 * 9
    shutil.copytree(f"{table}/pages", kept)
    assert stream.compact(spark, table, many=5) == 0
    assert stream.compact(spark, table, many=4) == len({_bucket(spark, "a.pdf"), _bucket(spark, "b.pdf")})
    assert rows() == whole
    for folder in (tmp_path / "table" / "pages" / "strategy=recursive").iterdir():
        if folder.name.startswith("bucket="):
            assert len([p for p in folder.iterdir() if p.name.startswith("part=")]) == 1
    shutil.copytree(kept, f"{table}/pages", dirs_exist_ok=True)  # as if it had failed before the old parts went
    assert rows() == whole
    stream.process_batch(_pages(spark, ["a.pdf", "b.pdf"], range(6, 9)), table, epoch="e3")  # a replay
    stream.process_batch(_pages(spark, ["a.pdf", "b.pdf"], range(9)), table, epoch="e4")
    assert rows() == whole
    assert stream.compact(spark, str(tmp_path / "none")) == 0
    (tmp_path / "old" / "pages" / "strategy=recursive" / "epoch=e0").mkdir(parents=True)
    with pytest.raises(ValueError):  # a ledger of another layout
        stream.process_batch(_pages(spark, ["a.pdf"]), str(tmp_path / "old"), epoch="e0")


def test_list_files_of_one_file_whatever_its_name(spark, tmp_path):
    for name in ("report.v1.docx", "noext"):
        (tmp_path / name).write_bytes(b"abc")
        for path in (str(tmp_path / name), f"file://{tmp_path / name}"):
            assert [(r.source, r.length) for r in list_files(spark, path).select("source", "length").collect()] == [(name, 3)]
    (tmp_path / "dotted.dir").mkdir()
    (tmp_path / "dotted.dir" / "a.pdf").write_bytes(b"1")
    (tmp_path / "dotted.dir" / "b.txt").write_bytes(b"1")
    assert [r.source for r in list_files(spark, str(tmp_path / "dotted.dir")).collect()] == ["a.pdf"]


def _write_page_files(folder):
    """A file of many pages, one with blank ones, an empty one, one with an odd name, one of another kind."""
    folder.mkdir()
    long = [f"page {i}\nsecond line " + "x" * (i % 90) for i in range(4000)]
    files = {"long.txt": long, "gaps.txt": ["", "two", " \n ", "four"], "empty.txt": [], "Odd [1] né+%41.v2.txt": ["only"]}
    for name, pages in files.items():
        (folder / name).write_text("\f".join(pages), encoding="utf-8")
    (folder / "other.csv").write_text("no\fpage")
    return {(n, i, p) for n, pages in files.items() for i, p in enumerate(pages, 1) if p.strip()}


def test_page_files_are_numbered_over_all_tasks_that_read_them(spark, tmp_path):
    want = _write_page_files(tmp_path / "in")
    for size in ("128m", "10k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = page_files(spark, f"file://{tmp_path}/in")
            rows = [(r.file_name, r.page_number, r.text) for r in got.collect()]
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert len(rows) == len(want) and set(rows) == want
    with pytest.raises(Exception):
        page_files(spark, str(tmp_path / "missing"))


def test_page_files_stream_loads_each_file_once(spark, tmp_path):
    _write_page_files(tmp_path / "in")
    (tmp_path / "in" / "long.txt").write_text("\f".join(f"p{i}" for i in range(30)))
    table = str(tmp_path / "table")
    for run in range(2):  # the second stream finds everything loaded but the new file
        stream.start_page_file_ingest(spark, str(tmp_path / "in"), table, str(tmp_path / f"ckpt{run}"), lang="en",
                                      max_files_per_trigger=3).awaitTermination()
        got = {(r.source, r.page_number): r.content for r in stream.read_table(spark, table).collect()}
        assert {k: v for k, v in got.items() if k[0] == "long.txt"} == {("long.txt", i + 1): f"p{i}" for i in range(30)}
        assert {k[1] for k in got if k[0] == "gaps.txt"} == {2, 4} and len(got) == 30 + 2 + 1 + run
        (tmp_path / "in" / "new.txt").write_text("new page")


def test_page_files_lie_by_volume_first(spark, monkeypatch):
    from ragloom.plans import corpus

    made = []
    monkeypatch.setattr(corpus, "scratch_path", lambda s, name, f=corpus.scratch_path: made.append(f(s, name)) or made[-1])
    rows = corpus.q_page_files(spark, SF001)
    assert rows.columns == ["source", "volume", "page_number", "text_md5"]
    top = [n for n in os.listdir(made[0].removeprefix("file:")) if "=" in n]
    assert top and all(n.startswith("volume=") for n in top)  # many folders at the top, which one job lists


def test_page_files_are_written_without_side_files(spark, tmp_path, monkeypatch):
    import hashlib

    from ragloom.plans import corpus

    docs = [(i, f"s{i % 3}" if i % 7 else None, " " if i % 5 == 0 else f"page {i}") for i in [*range(120), 7, 7]] + [(None, "s1", "no id")]
    spark.createDataFrame(docs, "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    made = []
    monkeypatch.setattr(corpus, "scratch_path", lambda s, name, f=corpus.scratch_path: made.append(f(s, name)) or made[-1])
    rows = corpus.q_page_files(spark, str(tmp_path)).collect()
    names = [n for _, _, found in os.walk(made[0].removeprefix("file:")) for n in found]
    assert names and not [n for n in names if n.startswith(".")]  # a checksum file costs a process and a file more
    want = {}
    for i, s, t in docs:
        want.setdefault((s, None if i is None else i // 50), []).append((i, t))
    want = sorted(((s, v, n, t) for (s, v), f in want.items() for n, (_, t) in enumerate(sorted(f, key=lambda x: x[0] or 0), 1) if t.strip()), key=str)
    assert sorted(((r.source, r.volume, r.page_number, r.text_md5) for r in rows), key=str) == sorted(
        ((s, v, n, hashlib.md5(t.encode()).hexdigest()) for s, v, n, t in want), key=str)
