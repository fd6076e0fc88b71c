"""Alignment of two tokenizers' tokens over the same texts, and corpus-wide counts of linked ids.

Per batch both sides' tokens are tables (document, first byte, id), and two as-of merges keyed by
document find for each token start the other side's covering token; the union of both directions
is all overlapping pairs. A token that starts where its covering token starts begins a group,
so groups lie between offsets where tokens of both sides end. Links are all pairs of a group.

Pairs of ids are counted by documents: a block of documents keeps its own distinct pairs, in which
its documents' links are numbers. Only those pairs are exchanged, summed over the blocks and
handed back to them, so a pair that every document has is one row of a block.
"""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom.llm.common import materialize
from ragloom.llm.encoding import BYTES, encoder, load_spec, piece_encoder, text_slices

SLICE, BLOCK = 1_500_000, 8_000_000  # bytes of text merged at once; of a block of documents
_COUNTS = ("n_a", "n_b", "n_groups", "n_links", "n_overlaps")
ALIGNED = ("block long, doc_id long, " + ", ".join(f"{c} long" for c in _COUNTS)
           + ", groups string, links binary, times binary, pairs binary, docs binary")
_TYPES = [pa.int64()] * 7 + [pa.string()] + [pa.binary()] * 4
_NAMES = [f.split()[0] for f in ALIGNED.split(", ")]


class _Side:
    """A tokenizer in a worker: ids of texts, and the bytes of every id."""

    def __init__(self, enc, tokens: list[bytes], letter: str):
        self.enc = enc
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.letter = letter

    def tokens(self, data: np.ndarray, offsets: np.ndarray):
        """(ids, first bytes, documents) of the texts whose joined token bytes are the text's, and which those are."""
        ids, bounds = self.enc.ids(data, offsets)
        ids = ids.astype(np.int64)
        size = self.size[ids]
        ends = np.cumsum(size)
        total = np.concatenate([[0], ends])[bounds]
        owner = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
        same = np.diff(total) == np.diff(offsets)
        if same.all():
            at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.start[ids] - (ends - size), size)
            differ = np.flatnonzero(self.flat[at] != data)
            same[np.searchsorted(offsets, differ, side="right") - 1] = False
        else:  # lengths differ somewhere: text by text
            for i in np.flatnonzero(same):
                own = ids[bounds[i]:bounds[i + 1]]
                same[i] = b"".join(self.flat[a:a + n].tobytes() for a, n in zip(
                    self.start[own].tolist(), self.size[own].tolist())) == data[offsets[i]:offsets[i + 1]].tobytes()
        return ids, ends - size - total[:-1][owner] + offsets[:-1][owner], owner, same


def byte_side(spec: str) -> _Side:
    enc = encoder(spec, plain=True)
    if enc.kind != "spaced":
        raise ValueError("the first tokenizer must be byte-level")
    of = {c: b for b, c in enumerate(BYTES)}
    tokens = [b""] * (max(enc.vocab.values()) + 1)
    for token, i in enc.vocab.items():
        tokens[i] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()
    return _Side(enc, tokens, "a")


def piece_side(model: bytes) -> _Side:
    enc = piece_encoder(model)
    sp = enc.model
    tokens = [bytes([int(p[3:-1], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode()
              for i in range(sp.get_piece_size()) for p in [sp.id_to_piece(i)]]
    return _Side(enc, tokens, "b")


def _covering(one: pd.DataFrame, other: pd.DataFrame) -> np.ndarray:
    """For each token start of one side the number of the other side's token that covers it."""
    found = pd.merge_asof(one[["start", "doc"]], other, on="start", by="doc")
    return found["token"].to_numpy(np.int64)


def _written(groups_a, groups_b, ids_a, ids_b, bounds) -> pa.Array:
    """`a1,a2|b1;a3|b2,b3` of each document: ids in the order of groups, first side first."""
    na, nb = len(ids_a), len(ids_b)
    place_a = np.arange(na) + np.searchsorted(groups_b, groups_a)
    place_b = np.arange(nb) + np.searchsorted(groups_a, groups_b, side="right")
    ids, side, group = (np.empty(na + nb, np.int64) for _ in range(3))
    ids[place_a], ids[place_b] = ids_a, ids_b
    side[place_a], side[place_b] = 0, 1
    group[place_a], group[place_b] = groups_a, groups_b
    # what follows an id: a comma in the same part, a bar between the sides, a semicolon between groups
    mark = np.full(na + nb, 2)
    mark[:-1] = np.where(group[1:] != group[:-1], 2, np.where(side[1:] != side[:-1], 1, 0))
    ends = bounds[1:][np.diff(bounds) > 0] - 1
    mark[ends] = 3
    distinct, codes = np.unique(ids * 4 + mark, return_inverse=True)
    texts = pa.array([f"{c >> 2}{',|;'[c & 3:(c & 3) + 1]}" for c in distinct.tolist()], pa.large_string())
    _, ends, data = texts.take(pa.array(codes)).buffers()  # all written parts, one after the other
    ends = np.frombuffer(ends, np.int64, na + nb + 1) if na + nb else np.zeros(1, np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(bounds) - 1, [None, pa.py_buffer(ends[bounds]), data or pa.py_buffer(b"")])


def align_slice(a: _Side, b: _Side, data: np.ndarray, offsets: np.ndarray) -> dict:
    """All of one slice: texts that begin with the space; text i from offsets[i] to offsets[i + 1]."""
    n = len(offsets) - 1
    sides = [s.tokens(data, offsets) for s in (a, b)]
    good = sides[0][3] & sides[1][3] & (np.diff(offsets) > 1)
    kept = []
    for ids, start, owner, _ in sides:
        use = good[owner]
        kept.append((ids[use], start[use], owner[use]))
    (ids_a, start_a, doc_a), (ids_b, start_b, doc_b) = kept
    table_a = pd.DataFrame({"start": start_a, "doc": doc_a, "token": np.arange(len(ids_a))})
    table_b = pd.DataFrame({"start": start_b, "doc": doc_b, "token": np.arange(len(ids_b))})
    under_a, under_b = _covering(table_a, table_b), _covering(table_b, table_a)
    begins_a, begins_b = start_b[under_a] == start_a, start_a[under_b] == start_b
    group_a, group_b = np.cumsum(begins_a) - 1, np.cumsum(begins_b) - 1
    # the directions share the pairs that begin together
    overlaps = np.bincount(doc_a, minlength=n) + np.bincount(doc_b[~begins_b], minlength=n)
    n_groups = int(begins_a.sum())
    size_b = np.bincount(group_b, minlength=n_groups)
    first_b = np.cumsum(size_b) - size_b
    each = size_b[group_a]
    last = np.cumsum(each)
    link_a = np.repeat(np.arange(len(ids_a)), each)
    link_b = np.arange(len(link_a)) - np.repeat(last - each, each) + np.repeat(first_b[group_a], each)
    pair, link_doc = (ids_a[link_a] << 32) | ids_b[link_b], doc_a[link_a]
    order = np.lexsort((pair, link_doc))
    pair, link_doc = pair[order], link_doc[order]
    new = np.ones(len(pair), bool)
    new[1:] = (pair[1:] != pair[:-1]) | (link_doc[1:] != link_doc[:-1])
    at = np.flatnonzero(new)
    count = lambda docs: np.bincount(docs, minlength=n)
    n_a, n_b = count(doc_a), count(doc_b)
    bounds = np.concatenate([[0], np.cumsum(n_a + n_b)])
    return {"n_a": n_a, "n_b": n_b, "n_groups": count(doc_a[begins_a]), "n_links": count(link_doc), "n_overlaps": overlaps,
            "groups": _written(group_a, group_b, ids_a, ids_b, bounds), "pair": pair[at],
            "times": np.diff(np.append(at, len(pair))).astype("<i4"),
            "bounds": np.concatenate([[0], np.cumsum(count(link_doc[at]))])}


def _block_rows(spec, model):
    def rows(batches):
        a, b = byte_side(spec.value), piece_side(model.value)
        block, keys, held, size = TaskContext.get().partitionId() << 33, [], [], 0

        def flush():
            distinct, codes = np.unique(np.concatenate([h["pair"] for h in held]), return_inverse=True)
            codes, docs = codes.astype("<i4"), np.bincount(codes, minlength=len(distinct)).astype("<i4")
            done = 0
            for own, h in zip(keys, held):
                cut = h["bounds"].tolist()
                part, times = codes[done:done + cut[-1]], h["times"]
                done += cut[-1]
                n, none = len(own), pa.nulls(len(own), pa.binary())
                slices = list(zip(cut, cut[1:]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, block)), own, *(pa.array(h[c].astype(np.int64)) for c in _COUNTS), h["groups"].cast(pa.string()),
                     pa.array([part[i:j].tobytes() for i, j in slices], pa.binary()),
                     pa.array([times[i:j].tobytes() for i, j in slices], pa.binary()), none, none], _NAMES)
            yield pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip([block, *[None] * 9, distinct.astype("<i8").tobytes(), docs.tobytes()], _TYPES)], _NAMES)

        for batch in batches:
            texts = pc.binary_join_element_wise(" ", pc.fill_null(batch.column(1), ""), "")
            at = 0
            for data, offsets in text_slices(texts, SLICE):
                keys.append(batch.column(0).slice(at, len(offsets) - 1))
                held.append(align_slice(a, b, data, offsets))
                at, size = at + len(offsets) - 1, size + len(data)
                if size >= BLOCK:
                    yield from flush()
                    block, keys, held, size = block + 1, [], [], 0
        if held:
            yield from flush()

    return rows


def _read(path: str) -> bytes:
    with open(os.path.expanduser(path), "rb") as f:
        return f.read()


def alignments(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_a, n_b (tokens), n_groups, n_links, n_overlaps (pairs whose bytes
    overlap), groups (text), and its links as numbers in its block's pairs; and one row per block (``pairs``
    is not null there). ``counted`` sums the pairs up. No exchange.

    Null and empty texts, and texts whose tokens' bytes are not the text's (an own space mark, say), have
    no tokens: zeros and empty groups. Repeated rows are documents of their own; a null id stays null;
    other columns are ignored; an empty table gives no rows. Very long texts are merged alone.
    """
    sc = docs.sparkSession.sparkContext
    spec, model = sc.broadcast(load_spec(byte_path)), sc.broadcast(_read(piece_path))  # files of a few MB
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        _block_rows(spec, model), ALIGNED)


def _pair_rows(batches):
    for batch in batches:
        for block, pairs, docs in zip(*(batch.column(i).to_pylist() for i in range(3))):
            pairs, docs = np.frombuffer(pairs, "<i8"), np.frombuffer(docs, "<i4")
            for a in range(0, len(pairs), 100_000):
                n = len(pairs[a:a + 100_000])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, block)), pa.array(np.arange(a, a + n, dtype=np.int32)),
                     pa.array(pairs[a:a + n]), pa.array(docs[a:a + n])], ["block", "place", "pair", "n"])


def _weigh(names: list[str]):
    def rows(docs: pa.Table, pairs: pa.Table) -> pa.Table:
        place = pairs.column("place").to_numpy()
        count, best = np.zeros((2, len(place)), np.int64)
        count[place], best[place] = pairs.column("count").to_numpy(), pairs.column("best").to_numpy()
        links, times = (docs.column(c).combine_chunks().cast(pa.large_binary()) for c in ("links", "times"))
        codes, t = (np.frombuffer(c.buffers()[2] or b"", "<i4", -1) if len(c) else np.zeros(0, "<i4") for c in (links, times))
        ends = np.frombuffer(links.buffers()[1], np.int64, len(links) + 1, links.offset * 8) // 4
        total = lambda x: np.concatenate([[0], np.cumsum(x)])
        c, b = total(count[codes] * t), total(best[codes] * t)
        return docs.select(names).append_column("n_best", pa.array(np.diff(b[ends]))).append_column(
            "count_sum", pa.array(np.diff(c[ends])))

    return rows


def counted(aligned: DataFrame) -> DataFrame:
    """The documents of ``alignments`` (and any columns added to it) with n_best, the links whose pair's
    count is the highest of its first id's pairs, and count_sum, the sum of the counts over the links. A
    pair's count is how many documents hold it linked.

    The blocks' distinct pairs are exchanged by pair, then by block; a pair has one row for a block, and
    Spark splits a frequent pair's rows in the join. A block meets its own pairs in one group, bounded by BLOCK.
    """
    held = materialize(aligned)
    names = [c for c in held.columns if c not in ("block", "links", "times", "pairs", "docs")]
    pairs = held.where("pairs is not null").select("block", "pairs", "docs").mapInArrow(
        _pair_rows, "block long, place int, pair long, n int")
    pairs = materialize(pairs)
    counts = pairs.groupBy("pair").agg(F.sum("n").alias("count"))
    counts = materialize(counts.withColumn("a", F.shiftright("pair", 32)))
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    marked = counts.join(most, "a").select("pair", "count", (F.col("count") == F.col("most")).cast("int").alias("best"))
    back = pairs.select("block", "place", "pair").join(marked, "pair").select("block", "place", "count", "best")
    docs = held.where("pairs is null").select("block", "links", "times", *names)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in names)
    return docs.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(
        _weigh(names), schema + ", n_best long, count_sum long")
