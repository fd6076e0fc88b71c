"""Chunk splitters: unit rows, invariants and Spark/Python agreement."""


from pyspark.sql import functions as F

from ragloom.operators import chunking as CH
from ragloom.sources import fixtures as X

from conftest import SF001


def test_separator_overlap_rows():
    text = "\n\n".join(["a" * 300, "b" * 300, "c" * 5, "d" * 300])
    out = CH.split_separator(text, "\n\n", 512, 10)
    assert out == ["a" * 300, "b" * 300 + "\n\n" + "c" * 5, "c" * 5 + "\n\n" + "d" * 300]


def test_separator_keeps_long_piece_whole():
    assert CH.split_separator("x" * 900, "\n\n", 512, 10) == ["x" * 900]


def test_recursive_invariants_on_fixture(spark):
    pages = X.pages(spark, SF001).select("source", "page_number", "text")
    chunks = CH.chunk_recursive(pages)
    assert chunks.where(F.length("content") > 512).count() == 0
    assert chunks.where(F.trim("content") == "").count() == 0
    # every word of every page appears in some chunk of that page
    words = pages.select("source", "page_number", F.explode(F.split("text", r"\s+")).alias("w")).where("w <> ''")
    joined = chunks.groupBy("source", "page_number").agg(F.concat_ws("\u0002", F.collect_list("content")).alias("all"))
    missing = words.join(joined, ["source", "page_number"]).where(~F.col("all").contains(F.col("w")))
    assert missing.count() == 0


def test_recursive_uses_smaller_separators():
    text = " ".join(["word"] * 300)  # no newline: splits on spaces
    out = CH.split_recursive(text, 512, 10)
    assert all(len(c) <= 512 for c in out) and len(out) >= 3
    assert " ".join(out).count("word") >= 300


def test_semantic_single_sentence_page_stays_whole(spark):
    df = spark.createDataFrame([("s", 1, "one sentence without a break"), ("s", 2, "A. B. C. D. E.")],
                               "source string, page_number long, text string")
    rows = CH.chunk_semantic(df).collect()
    got = {(r.page_number, r.content) for r in rows}
    assert (1, "one sentence without a break") in got
    assert " ".join(r.content for r in sorted([r for r in rows if r.page_number == 2], key=lambda r: r.chunk_index)) \
        == "A. B. C. D. E."


def test_pages_are_split_in_bounded_parts(spark):
    import pyarrow as pa

    text = " ".join(["word"] * 40_000)  # 200 kB
    batch = pa.RecordBatch.from_pydict({"page": list(range(30)), "_text": [text, None, ""] * 10})
    split = lambda t: CH.split_recursive(t, 512, 10)
    parts = list(CH._split_batches(split, [batch]))
    assert len(parts) > 1 and max(p.nbytes for p in parts) < 2 * CH.PAGES_AT_ONCE
    rows = [r for p in parts for r in p.to_pylist()]
    assert rows == [{"page": i, "chunk_index": k, "content": c} for i in range(0, 30, 3) for k, c in enumerate(split(text))]
    pages = spark.createDataFrame([("s", 1, "a\nb"), (None, 2, None), (None, 3, ""), (None, 4, "c " * 700)], "source string, page_number int, text string")
    got = CH.chunk_recursive(pages)
    assert got.dtypes == [("source", "string"), ("page_number", "int"), ("chunk_index", "bigint"), ("content", "string")]
    assert sorted((r.page_number, r.chunk_index, r.content) for r in got.collect()) == [
        (p, k, c) for p, t in ((1, "a\nb"), (4, "c " * 700)) for k, c in enumerate(split(t))]


def test_semantic_in_sql_equals_the_arrow_form_without_an_exchange(spark):
    import random

    rnd = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "été", "x1"]
    page = lambda n: "".join(" ".join(rnd.choices(words, k=rnd.randint(0, 9))) + rnd.choice([". ", "? ", "!\n", ".  ", " ", "."]) for _ in range(n))
    rows = [(f"s{i % 3}", i, page(rnd.randint(1, 30))) for i in range(40)]
    rows += [("s0", 100, "one sentence only"), ("s0", 101, "a b. c d."), ("s0", 102, "..., !! ?? -- ."), ("s0", 103, "alpha " * 3000 + "beta. gamma. " * 3),
             ("s0", 104, ""), ("s0", 105, None)]
    df = spark.createDataFrame(rows, "source string, page_number long, text string")
    known = spark.createDataFrame([r for r in rows if r[2]], df.schema)
    key = lambda d: sorted(tuple(r) for r in d.collect())
    for kw in ({}, {"buffer": 2, "dim": 16}, {"buffer": 0, "percentile": 0.5}, {"percentile": 1.0}):
        got = CH.chunk_semantic_relational(df, **kw)
        assert key(got) == key(CH.chunk_semantic(known, **kw))
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    # a page with a null key stays whole
    text = " ".join(f"{a} {a}." for a in words)
    one = spark.createDataFrame([(None, 1, text)], df.schema)
    assert [tuple(r) for r in CH.chunk_semantic_relational(one, percentile=0.5).collect()] == [(None, 1, 0, text)]
