"""Alignment against plain loops over the libraries' own tokens."""

import random
from collections import Counter

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ragloom.llm import alignment
from ragloom.llm.encoding import BYTES

BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain(texts):
    """Groups of each text: lists of (ids, ids)."""
    lib = Tokenizer.from_file(BYTE)
    lib.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    of = {c: b for b, c in enumerate(BYTES)}
    out = []
    for t in texts:
        a = b = []
        if t:
            e = lib.encode(" " + t, add_special_tokens=False)
            a = [(i, bytes(of[c] for c in lib.id_to_token(i))) for i in e.ids]
            b = [(i, bytes([int(sp.id_to_piece(i)[3:-1], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode())
                 for i in sp.encode(t)]
            if not b"".join(x for _, x in a) == b"".join(x for _, x in b) == (" " + t).encode():
                a = b = []
        ends = []
        for side in (a, b):
            at, e = 0, []
            for _, x in side:
                at += len(x)
                e.append(at)
            ends.append(e)
        cuts = sorted(set(ends[0]) & set(ends[1]))
        out.append([([i for (i, _), e in zip(a, ends[0]) if lo < e <= hi], [i for (i, _), e in zip(b, ends[1]) if lo < e <= hi])
                    for lo, hi in zip([0, *cuts], cuts)])
    return out


def check(spark, rows, monkeypatch=None):
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, pair int, BLOCK string").repartition(3)
    got = alignment.counted(alignment.alignments(df, BYTE, PIECE)).collect()
    groups = plain([t for _, t in rows])
    held = Counter(p for g in groups for p in {(i, j) for x, y in g for i in x for j in y})
    most = Counter()
    for (i, _), n in held.items():
        most[i] = max(most[i], n)
    want = []
    for (d, _), g in zip(rows, groups):
        links = [(i, j) for x, y in g for i in x for j in y]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        want.append((str(d), sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(links),
                     sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links), text))
    assert sorted((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in got) == sorted(want)
    assert all(max(r.n_a, r.n_b) <= r.n_overlaps <= r.n_links for r in got)


def test_equals_plain_loops(spark):
    rng = random.Random(4)
    parts = ["the ", "And ", "un", "für ", "日本語", " ", "  ", "\n", "ing", "👍🏽", "x.", "12345 ", "<|endoftext|>", "<s>", "▁", "é", "\t", "$$$ "]
    rows = [(i, "".join(rng.choices(parts, k=rng.randint(0, 30)))) for i in range(150)]
    rows += [(900, None), (901, ""), (902, " "), (None, "null id"), (903, "x y " * 3000), (904, "a" * 5000), (5, rows[5][1]), (6, rows[5][1])]
    check(spark, rows)


def test_blocks_share_counts(spark, monkeypatch):
    rows = [(i, f"the same words and number {i % 3}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = alignment.counted(alignment.alignments(df, BYTE, PIECE))
    assert got.groupBy("groups").agg(F.countDistinct("count_sum", "n_best").alias("n")).where("n > 1").count() == 0
    assert got.agg(F.max("count_sum")).first()[0] >= 60 * 5
    check(spark, rows)


def test_empty_table(spark):
    assert alignment.counted(alignment.alignments(spark.createDataFrame([], "doc_id long, text string"), BYTE, PIECE)).count() == 0
