"""Token files and packing: against the tokenizers library, exact round trips, brute force."""

import random
import uuid
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ragloom.llm import packing
from ragloom.llm.encoding import Encoder, load_spec
from ragloom.llm.token_files import EliasFano, read_token_files, write_token_files
from ragloom.session import scratch_path

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", " ", "  two  spaces ", "a b", "It's we'll\nnew line \n mixed\t tab  x", "é̂ é Σας ΟΔΟΣ", "x" * 5000,
         "1234 5 6,7 . ..", "<|endoftext|> and <|startoftext|>x", "nb sp   a　b \x1c c", " lead", "trail ",
         "don 't  do 's", "\n\n a", "日本語 テキスト 👍🏽 ok", "a  \n  b", "tab\tonly\tok", "ﬁ ligature ỗ", "word" * 40 + " z"]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_encoder_equals_the_library(path):
    enc, lib = Encoder(load_spec(path)), Tokenizer.from_file(path)
    assert enc.kind in ("spaced", "dropped")
    rng = random.Random(1)
    alphabet = ["a", "The", " ", "  ", "\n", "'s", "é", "9", ".", "́", " ", "\t", "ing", "<|endoftext|>"]
    texts = TEXTS + ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(400)]
    got = [np.frombuffer(b, enc.dtype).tolist() for b in enc.encode(texts)]
    assert got == [lib.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("values", [[], [0], [5, 5, 5], list(range(1000)), [-7, -7, 0, 3, 2**62], [0, 2**40, 2**40 + 1],
                                    sorted(random.Random(3).choices(range(10**6), k=3000))])
def test_elias_fano_round_trip_and_select(values):
    ef = EliasFano.from_bytes(EliasFano.of(np.array(values, np.int64)).to_bytes())
    assert ef.values().tolist() == values
    assert [ef.select(i) for i in range(len(values))] == values
    with pytest.raises(IndexError):
        ef.select(len(values))


def test_elias_fano_is_small():
    ends = np.cumsum(np.random.default_rng(0).integers(100, 2000, 100_000))
    assert len(EliasFano.of(ends).to_bytes()) < 100_000 * 2  # 64-bit offsets take 8 bytes each


DOCS = [(3, "b c"), (1, None), (1, "the cat's"), (7, "x " * 20000), (None, "null id"), (1, "the cat's"), (-5, ""), (9, "é")]


def test_token_files_hold_all_documents_in_order(spark):
    df = spark.createDataFrame([(*d, 1, "z") for d in DOCS], "doc_id long, text string, ids int, START string")
    path = scratch_path(spark, f"t/{uuid.uuid4().hex}")
    write_token_files(df, path, WORD, 1, segment_tokens=8)
    lib = Tokenizer.from_file(WORD)
    rows = sorted(read_token_files(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted((d for d, _ in DOCS), key=lambda d: (d is not None, d))
    want = sorted((d is not None, d or 0, tuple([*lib.encode(t or "", add_special_tokens=False).ids, 1])) for d, t in DOCS)
    got = sorted((r.doc_id is not None, r.doc_id or 0, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in rows)
    assert got == want
    at = 0
    for r in rows:
        assert r.start == at and r.n_tokens == len(r.ids) // 4
        at += r.n_tokens
    empty = scratch_path(spark, f"t/{uuid.uuid4().hex}")
    write_token_files(df.limit(0), empty, WORD, 1)
    assert read_token_files(spark, empty).count() == 0


def least_bins(sizes, capacity):
    """The fewest bins, by trying every place for each piece."""
    best = len(sizes)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for k in {b: k for k, b in enumerate(bins) if b + sizes[i] <= capacity}.values():
            bins[k] += sizes[i]
            place(i + 1, bins)
            bins[k] -= sizes[i]
        place(i + 1, [*bins, sizes[i]])

    sizes = sorted(sizes, reverse=True)
    place(0, [])
    return best


def test_reduction_loses_no_bin():
    rng = random.Random(5)
    reduced = 0
    for _ in range(300):
        capacity = rng.randint(5, 24)
        sizes = [rng.randint(max(1, capacity // 5), capacity) for _ in range(rng.randint(1, 9))]
        counts = np.bincount(sizes, minlength=capacity + 1)
        rest = counts.copy()
        fixed = packing.reduce(rest, capacity)
        assert all(sum(b) <= capacity for b, _ in fixed)
        left = [s for s in range(capacity + 1) for _ in range(rest[s])]
        n = sum(t for _, t in fixed)
        assert sum(len(b) * t for b, t in fixed) + len(left) == len(sizes)
        assert n + (least_bins(left, capacity) if left else 0) == least_bins(sizes, capacity)
        reduced += bool(fixed)
    assert reduced > 200


def test_plan_places_every_piece_once():
    rng = np.random.default_rng(2)
    for capacity, n in ((7, 50), (100, 5000), (2048, 20000)):
        sizes = rng.integers(1, capacity + 1, n)
        counts = np.bincount(sizes, minlength=capacity + 1)
        patterns = packing.plan(counts, capacity)
        got = np.zeros(capacity + 1, np.int64)
        for p, times in patterns:
            assert sum(s * q for s, q in p) <= capacity and times > 0
            for s, q in p:
                got[s] += q * times
        assert (got == counts).all()
        bins = sum(t for _, t in patterns)
        assert bins <= -(-int((sizes).sum()) // capacity) * 1.1 + 1


def test_pack_documents(spark):
    lib = Tokenizer.from_file(BYTE)
    df = spark.createDataFrame([(*d, 5) for d in DOCS], "doc_id long, text string, length int")
    capacity = 64
    packed = packing.pack_documents(df, BYTE, 0, capacity, keep_ids=True)
    rows = packed.collect()
    want = [[*lib.encode(t or "", add_special_tokens=False).ids, 0] for _, t in DOCS]
    assert sum(r.length for r in rows) == sum(map(len, want))
    by_seq = {}
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length and zlib.crc32(r.ids) == r.ids_crc32
        assert r.length == capacity or r.piece == 0
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_seq.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    long_ = sorted((r for r in rows if r.doc_id == 7), key=lambda r: r.piece)
    assert np.concatenate([np.frombuffer(r.ids, "<u4") for r in long_]).tolist() == want[3]
    assert [r.start for r in long_] == np.cumsum([0, *[r.length for r in long_][:-1]]).tolist()
    seqs = packing.sequences(packed).collect()
    assert sum(r.n_tokens for r in seqs) == sum(map(len, want)) and all(len(r.ids) == 4 * r.n_tokens for r in seqs)
    assert packing.pack_documents(df.limit(0), BYTE, 0, capacity).count() == 0
