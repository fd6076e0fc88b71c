"""Quality by nearest-neighbour voting among labelled documents in a latent-semantic space.

A document is a vector of hashed runs of three bytes (case and marks kept, white space alike) and of
how much of it repeats the word before, weighted by log counts and inverse document frequency. A truncated
singular value decomposition of the labelled documents' vectors gives the latent axes. The labelled
latent vectors are broadcast; every document's cosines with all of them are computed exactly, block
by block, and its nearest neighbours vote with their similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom.llm.common import fresh
from ragloom.llm.encoding import text_slices
from ragloom.llm.toxicity import held_out

MAX_LABELLED = 4_000  # labelled documents that vote
BUCKETS, REPEATS = 4096, 8  # hashed runs; steps of the share of repeated words
WIDTH = BUCKETS + REPEATS
AXES, NEIGHBOURS, SHARPNESS = 48, 25, 4
BLOCK, SLICE = 256, 400_000  # documents in a block; bytes of text counted at once
_SPACE = bytes(0x20 if c in b"\t\n\x0b\x0c\r" else c for c in range(256))


def word_places(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bytes and lengths of the words (runs without 0x20) of texts that lie one after the other."""
    inside = raw != 0x20
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(raw))]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1 - start


def word_codes(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The number of each word among the distinct ones, and those."""
    inside = np.zeros(len(raw) + 1, np.int8)
    np.add.at(inside, start, 1)
    np.add.at(inside, start + size, -1)
    data = raw[np.cumsum(inside[:-1]).astype(bool)] if len(raw) else raw
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])
    found = words.dictionary_encode()
    return found.indices.to_numpy(), found.dictionary


def counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of each text's runs of three bytes by bucket, and one mark for its share of repeated words."""
    n = len(offsets) - 1
    raw = np.frombuffer(data.tobytes().translate(_SPACE), np.uint8)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    wide = raw.astype(np.uint32)
    runs = (wide[:-2] * 0x9E3779B1 + wide[1:-1] * 0x85EBCA77 + wide[2:] * 0xC2B2AE3D) if len(raw) > 2 else np.zeros(0, np.uint32)
    runs = (runs ^ (runs >> 15)) * np.uint32(0x2C1B3C6D)
    one = owner[:-2] == owner[2:] if len(raw) > 2 else np.zeros(0, bool)
    at = owner[:-2][one] * WIDTH + (runs[one] >> 20).astype(np.int64) if len(raw) > 2 else np.zeros(0, np.int64)
    out = np.bincount(at, minlength=n * WIDTH).astype(np.float32).reshape(n, WIDTH)
    start, size = word_places(raw, offsets)
    codes, _ = word_codes(raw, start, size)
    of = owner[start]
    again = (codes[1:] == codes[:-1]) & (of[1:] == of[:-1])
    n_words = np.bincount(of, minlength=n)
    share = np.bincount(of[1:][again], minlength=n) / np.maximum(1, n_words)
    full = np.flatnonzero(n_words)
    # the mark weighs like all runs of the text together
    out[full, BUCKETS + np.minimum(REPEATS - 1, (share[full] * REPEATS).astype(int))] = np.maximum(1, np.diff(offsets)[full])
    return out


def blocks(texts: pa.Array):
    """Counts of some texts of an Arrow column after the other; null counts as empty."""
    for data, offsets in text_slices(texts, SLICE):
        for a in range(0, len(offsets) - 1, BLOCK):
            part = offsets[a:a + BLOCK + 1]
            yield counts(data[part[0]:part[-1]], part - part[0])


def weighted(x: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(x) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


class Model:
    """Weights of features, latent axes, and the labelled documents' latent vectors and labels."""

    def __init__(self, idf: np.ndarray, axes: np.ndarray, vectors: np.ndarray, labels: np.ndarray):
        self.idf, self.axes, self.vectors, self.labels = idf, axes, vectors, labels

    def latent(self, x: np.ndarray) -> np.ndarray:
        z = weighted(x, self.idf) @ self.axes
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)

    def score(self, x: np.ndarray) -> np.ndarray:
        """The similarity-weighted share of label 1 among the nearest neighbours of each row of counts; the share
        among all labelled documents where none is similar; 0 if nothing is labelled."""
        if not len(self.labels):
            return np.zeros(len(x))
        similar = self.latent(x) @ self.vectors.T
        k = min(NEIGHBOURS, len(self.labels))
        near = np.argpartition(-similar, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(similar, near, 1).astype(np.float64), 0) ** SHARPNESS
        total = weight.sum(axis=1)
        share = (weight * self.labels[near]).sum(axis=1) / np.where(total > 0, total, 1)
        return np.where(total > 1e-9, share, self.labels.mean())


def fit(x: np.ndarray, labels: np.ndarray, idf: np.ndarray, axes: int = AXES) -> Model:
    """Latent axes by subspace iteration on the labelled documents' weighted counts."""
    if not len(labels):
        return Model(idf, np.zeros((WIDTH, 0), np.float32), np.zeros((0, 0), np.float32), labels)
    w = weighted(x, idf).astype(np.float32)
    k = min(axes, len(labels))
    q = np.random.default_rng(7).standard_normal((WIDTH, k)).astype(np.float32)
    for _ in range(12):
        q, _ = np.linalg.qr(w.T @ (w @ q))
    # the axes by falling singular value
    _, _, turn = np.linalg.svd(w @ q, full_matrices=False)
    model = Model(idf, (q @ turn.T).astype(np.float32), np.zeros((0, 0), np.float32), labels.astype(np.float64))
    model.vectors = model.latent(x).astype(np.float32)
    return model


# ---- Spark ---------------------------------------------------------------------------------

def _frequency_rows(batches):
    seen, n = np.zeros(WIDTH, np.int64), 0
    for batch in batches:
        for x in blocks(batch.column(0)):
            seen += (x > 0).sum(axis=0)
            n += len(x)
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(seen[at], n), pa.int64())], ["f", "n"])


def _count_rows(batches):
    for batch in batches:
        done = 0
        for x in blocks(batch.column(1)):
            data = [r.tobytes() for r in x]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(x)), pa.array(data, pa.binary())], ["y", "x"])
            done += len(x)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          max_labelled: int = MAX_LABELLED) -> Model:
    """A model from the labelled documents that are not held out, at most ``max_labelled`` by the order of
    their ids' hash. Document frequencies are counted over all of ``docs``. Several labels of a document
    count as the lowest; of an id that several rows have one text is used, that of the least hash. Null
    ids and labels are ignored; null and empty texts have no features.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(
        F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("y"))
    ids = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id")).distinct()
    chosen = known.join(ids, "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(max_labelled)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(chosen), "id")  # at most max_labelled rows
    rows = rows.groupBy("id").agg(F.min("y").alias("y"), F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    rows = rows.select("y", "text").mapInArrow(_count_rows, "y int, x binary")
    found = rows.toArrow()
    frequency = docs.select(text_col).mapInArrow(_frequency_rows, "f int, n long").groupBy("f").agg(F.sum("n").alias("n"))
    seen, n = np.zeros(WIDTH), 0
    for f, c in frequency.collect():  # at most WIDTH + 1 rows
        if f < 0:
            n = c
        else:
            seen[f] = c
    idf = np.log((n + 1) / (seen + 1)).astype(np.float32)
    idf[BUCKETS:] += 0.5  # the marks of repetition are few
    x = np.array([np.frombuffer(v.as_py(), np.float32) for v in found.column("x")], np.float32).reshape(-1, WIDTH)
    return fit(x, np.array(found.column("y").to_pylist(), np.float64), idf)


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """Adds the score (0 to 1) of every whole text to the rows, repeated rows alike; no exchange. The model is
    broadcast: WIDTH * AXES numbers and at most ``max_labelled`` vectors of AXES numbers. Null and empty
    texts resemble nothing and get the labelled documents' share of label 1."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of = held.value.score
        for texts in batches:
            yield pa.array(np.concatenate([np.zeros(0), *(of(x) for x in blocks(texts))]), pa.float64())

    return docs.withColumn(out, F.arrow_udf(scored, "double")(F.col(text_col)))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.3,
              **options) -> DataFrame:
    """The rows of ``docs``, all columns, that score at least ``least``; all rows if nothing is labelled."""
    model = train(docs, labels, id_col, text_col, **options)
    if not len(model.labels):
        return docs
    (name,) = fresh(docs, "_score")
    return score(docs, model, text_col, name).where(F.col(name) >= least).drop(name)
