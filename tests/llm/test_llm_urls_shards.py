"""URL verdicts by hand-made cases; shards by their laws."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ragloom.llm.sharding import shard_documents, splitters
from ragloom.llm.url_reputation import allowed_pages, domain_of, host_reputation, judge_urls, suffix_of

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block")]
CASES = [  # url, host, path, rule
    ("http://A.Example.COM/en/x?q#f", "a.example.com", "/en/x", "example.com/en/"),
    ("https://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/"),
    ("https://x.www.example.com/en/", "x.www.example.com", "/en/", "www.example.com/en/"),
    ("http://example.com/EN/", "example.com", "/EN/", "com/"),
    ("http://notcom/", "notcom", "/", None), ("http://com", "com", "", None), ("http://com/", "com", "/", "com/"),
    ("http://a.net?x=/es/", "a.net", "", None), ("ftp://a.net/es/#", "a.net", "/es/", "net/es/"),
    (None, "", "", None), ("", "", "", None), ("example.com/en/", "", "", None), ("a://b://c/d", "b:", "//c/d", None),
    ("http://É.Com/é", "É.com", "/é", "com/"), ("x" * 100000 + "://com/" + "y" * 100000, "com", "/" + "y" * 100000, "com/"),
]


def test_hosts_paths_rules(spark):
    pages = spark.createDataFrame([(i, c[0], "x", 0) for i, c in enumerate(CASES)] + [(0, CASES[0][0], "x", 0), (None, CASES[1][0], "x", 1)],
                                  "page_id long, url string, Path string, _key int")
    outcomes = spark.createDataFrame([(0, True), (0, None), (99, True), (None, False)], "page_id long, bad boolean")
    out = judge_urls(pages, outcomes, RULES)
    assert out.columns == ["page_id", "url", "Path", "_key", "host", "path_", "rule", "verdict"]
    rows = out.collect()
    assert len(rows) == len(CASES) + 2
    verdicts = {h + p: v for h, p, v in RULES}
    for r in rows:
        if r.page_id is not None:
            assert (r.url, r.host, r.path_, r["rule"]) == CASES[r.page_id]
        assert r.verdict == verdicts.get(r["rule"], r.verdict) and r.verdict in ("allow", "block")
    assert judge_urls(pages.limit(0), outcomes, RULES).count() == 0
    assert judge_urls(pages, outcomes.limit(0), RULES).count() == len(rows)
    assert allowed_pages(pages, outcomes, RULES).columns == pages.columns


def test_domains(spark):
    hosts = {"a.b.example.com": ("example.com", "com"), "x.y.co.uk": ("y.co.uk", "co.uk"), "co.uk": ("co.uk", "uk"),
             "u@h.org:80": ("h.org", "org"), "local": ("local", ""), "": ("", "")}
    df = spark.createDataFrame([(h,) for h in hosts], "h string").select("h", domain_of(F.col("h")).alias("d"))
    assert {r.h: (r.d, r.s) for r in df.select("h", "d", suffix_of(F.col("d")).alias("s")).collect()} == hosts


def test_reputation_shrinks_and_blocks(spark):
    rng = random.Random(0)
    pages, labels, i = [], [], 0
    for d in range(30):
        for s in range(3):
            share = 0.95 if d < 6 else 0.05
            for _ in range(40 if s else 4):
                pages.append((i, f"http://h{s}.d{d}.org/{i}"))
                if s or d % 2:
                    labels.append((i, rng.random() < share))
                i += 1
    df = spark.createDataFrame(pages, "page_id long, url string")
    rep = {r.host: r for r in host_reputation(df, spark.createDataFrame(labels, "page_id long, bad boolean")).collect()}
    for d in range(30):
        for s in range(3):
            r = rep[f"h{s}.d{d}.org"]
            assert r.blocked == (d < 6) or r.n == 0  # without own outcomes the domain speaks, with less certainty
            assert (r["mean"] > 0.5) == (d < 6) and 0 < r["mean"] < 1
            if 0 < r.n < 10:
                assert min(r.bad / r.n, 0.9) - 0.9 <= r["mean"]  # shrunk


def laws(rows, n_shards):
    sizes, slots = defaultdict(int), defaultdict(list)
    for r in rows:
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(slots) <= set(range(n_shards))
    return sizes


@pytest.mark.parametrize("n_shards", [1, 7, 40])
def test_shards_are_even_also_with_a_hot_text(spark, n_shards):
    rng = random.Random(n_shards)
    docs = [(i, "hot text " * 8 if i % 3 == 0 else f"{i} " * rng.randint(0, 60)) for i in range(6000)]
    docs += [(6000, None), (6001, ""), (None, "null id"), (-5, "x")]
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, SIZE int, shard int").repartition(5)
    out = shard_documents(df, n_shards)
    assert out.columns == ["doc_id", "text", "SIZE", "shard", "size_", "shard_", "slot"]
    rows = out.select("doc_id", "text", F.col("size_").alias("size"), F.col("shard_").alias("shard"), "slot").collect()
    assert len(rows) == len(docs)
    assert all(r.size == len((r.text or "").encode()) + 16 for r in rows)
    sizes = laws(rows, n_shards)
    mean, largest = sum(sizes.values()) / n_shards, max(r.size for r in rows)
    assert len(sizes) == n_shards and all(abs(s - mean) <= 2 * largest + mean * 0.002 for s in sizes.values())


def test_repeated_rows_and_empty(spark):
    df = spark.createDataFrame([(1, "same")] * 50 + [(2, "other")] * 3, "doc_id long, text string")
    rows = shard_documents(df, 4).collect()
    laws(rows, 4)
    assert len(rows) == 53 and len({r.shard for r in rows if r.doc_id == 1}) == 1
    assert shard_documents(df.limit(0), 4).count() == 0


def test_splitters_are_exact(spark):
    rng = random.Random(3)
    keys = sorted((rng.choice([-2**63, -1, 0, 5, 2**63 - 1, rng.getrandbits(63)]), rng.randrange(-10, 10), rng.randint(1, 50)) for _ in range(500))
    bounds, n = splitters(spark.createDataFrame(keys, "h long, i long, size long"), 5, tolerance=0.0)
    total, at = sum(k[2] for k in keys), sorted({k[:2] for k in keys})
    below = lambda b: sum(k[2] for k in keys if k[:2] < b)
    assert n == 500 and bounds == sorted(bounds)
    for j, b in enumerate(bounds, 1):
        assert abs(below(b) - total * j / 5) == min(abs(below(a) - total * j / 5) for a in [*at, (2**64, 0)])
