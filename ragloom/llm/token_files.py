"""Token-ID output: all ids of a corpus in one row of segments, with the documents'
boundaries Elias-Fano encoded.

The file format is a folder of Parquet files, written by Spark's committing writer (so a lost
executor leaves nothing behind, and any store Spark can write will do). One row is a segment:
some documents with ascending id, and in binary columns the concatenated ids, the ends of
the documents in the id array and their document ids, both as Elias-Fano lists.
An Elias-Fano list of n numbers below u takes about n * (2 + log2(u / n)) bits; number i is
found by one select in its upper bits, without a table of 64-bit offsets.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ragloom.llm.common import fresh
from ragloom.llm.encoding import encode_column, encoder, load_spec

SEGMENT_TOKENS = 1 << 20
SAMPLE = 256  # every so many ones of the upper bits the position is noted
_HEAD = struct.Struct("<4sIQBQ")  # magic, n, least value, low bits, bytes of upper bits
MAGIC = b"RGEF"

SEGMENT_SCHEMA = ("pid int, seq int, part_start long, n_docs int, n_nulls int, n_tokens long, width int, "
                  "doc_ids binary, ends binary, ids binary")


class EliasFano:
    """A non-decreasing list of integers within 63 bits of each other.

    Value i less the least one is stored as ``low`` bits of its lower part, packed, and of the
    rest a one at bit (upper part + i) of a bit string."""

    def __init__(self, n: int, least: int, low: int, lower: np.ndarray, upper: np.ndarray, samples: np.ndarray):
        self.n, self.least, self.low = n, least, low
        self.lower, self.upper, self.samples = lower, upper, samples

    @classmethod
    def of(cls, values: np.ndarray) -> "EliasFano":
        n = len(values)
        if n == 0:
            return cls(0, 0, 0, *(np.zeros(0, t) for t in ("u1", "u1", "<u8")))
        least = int(values[0])
        rest = values.astype(np.int64).view(np.uint64) - np.int64(least).view(np.uint64)
        if np.any(rest[1:] < rest[:-1]):
            raise ValueError("the list must not decrease")
        low = max(0, (int(rest[-1]) // n).bit_length() - 1)
        ones = (rest >> np.uint64(low)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1, np.uint8)
        bits[ones] = 1
        lower = (rest[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1) if low else np.zeros((n, 0))
        return cls(n, least, low, np.packbits(lower.astype(np.uint8).ravel(), bitorder="little"),
                   np.packbits(bits, bitorder="little"), ones[::SAMPLE].astype("<u8"))

    def select(self, i: int) -> int:
        """Value i: the place of the i-th one, from the nearest noted place on."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, rest = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = at // 8
        skip, step = at % 8, 64
        while True:  # a few bytes at a time, until the remaining ones are found
            bits = np.unpackbits(self.upper[byte:byte + step], bitorder="little")
            ones = np.flatnonzero(bits[skip:])
            if len(ones) > rest:
                place = byte * 8 + skip + int(ones[rest])
                break
            rest -= len(ones)
            byte, skip = byte + step, 0
        return self.least + (((place - i) << self.low) | self._low(i))

    def _low(self, i: int) -> int:
        a = i * self.low
        chunk = int.from_bytes(self.lower[a // 8:(a + self.low + 7) // 8].tobytes(), "little")
        return (chunk >> (a % 8)) & ((1 << self.low) - 1)

    def values(self) -> np.ndarray:
        """All values."""
        ones = np.flatnonzero(np.unpackbits(self.upper, bitorder="little"))[: self.n]
        out = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low)
        if self.low and self.n:
            bits = np.unpackbits(self.lower, count=self.n * self.low, bitorder="little").reshape(self.n, self.low)
            out |= (bits.astype(np.uint64) << np.arange(self.low, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return (out + np.int64(self.least).view(np.uint64)).view(np.int64)

    def to_bytes(self) -> bytes:
        head = _HEAD.pack(MAGIC, self.n, self.least % (1 << 64), self.low, len(self.upper))
        return head + self.upper.tobytes() + self.lower.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> "EliasFano":
        magic, n, least, low, size = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("no Elias-Fano list")
        a = _HEAD.size
        b = a + size
        c = b + (n * low + 7) // 8
        part = lambda i, j: np.frombuffer(data, np.uint8, j - i, i)
        return cls(n, least - (1 << 64) if least >> 63 else least, low, part(b, c), part(a, b),
                   np.frombuffer(data[c:], "<u8"))


def _segment_rows(spec, end_id: int, segment_tokens: int):
    """Batches of (doc id, text) in order -> one row per segment."""
    names = [f.split()[0] for f in SEGMENT_SCHEMA.split(", ")]

    def rows(batches):
        enc = encoder(spec.value)
        end = np.array([end_id], enc.dtype)
        pid, seq, done = TaskContext.get().partitionId(), 0, 0
        ids, sizes, held, total = [], [], [], 0

        def row():
            nonlocal seq, done, total
            known = np.array([d for d in held if d is not None], np.int64)
            values = (pid, seq, done, len(held), len(held) - len(known), total, enc.dtype.itemsize,
                      EliasFano.of(known).to_bytes(), EliasFano.of(np.cumsum(sizes)).to_bytes(), np.concatenate(ids).tobytes())
            seq, done, total = seq + 1, done + total, 0
            ids.clear(), sizes.clear(), held.clear()
            types = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(),
                     pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names)

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for key, found in zip(keys, encode_column(enc, batch.column(1))):
                held.append(key)
                ids += (found, end)
                sizes.append(len(found) + 1)
                total += sizes[-1]
                if total >= segment_tokens:
                    yield row()
        if held:
            yield row()

    return rows


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id",
                      text_col: str = "text", segment_tokens: int = SEGMENT_TOKENS) -> None:
    """Encode every text of ``docs`` (null: empty), append ``end_id`` to each, and write the ids to
    ``path`` in ascending order of ``id_col``, nulls first; rows of equal id by their text's hash.

    One range exchange of the texts; the ids are made after it, in order, so they are never
    shuffled. A segment has some ``segment_tokens`` ids, or one document if that has more;
    equal ids may lie in several partitions, so no key gathers in one task. An empty table
    writes no segment. Other columns are ignored.
    """
    spec = docs.sparkSession.sparkContext.broadcast(load_spec(tokenizer_path))  # one file, a few MB
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"),
                       F.xxhash64(F.col(text_col)).alias("tie"))
    rows = rows.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie").select("id", "text")
    rows.mapInArrow(_segment_rows(spec, end_id, segment_tokens), SEGMENT_SCHEMA).write.mode("errorifexists").parquet(path)


def _document_rows(batches):
    for batch in batches:
        for r in batch.to_pylist():
            ends = EliasFano.from_bytes(r["ends"]).values()
            keys = [None] * r["n_nulls"] + EliasFano.from_bytes(r["doc_ids"]).values().tolist()
            ids = np.frombuffer(r["ids"], f"<u{r['width']}").astype("<u4")
            sizes = np.diff(ends, prepend=0)
            data, offsets = ids.tobytes(), np.concatenate(([0], ends)) * 4
            for a in range(0, len(keys), 4096):  # batches of bounded size
                b = min(a + 4096, len(keys))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[a:b], pa.int64()), pa.array(r["start"] + ends[a:b] - sizes[a:b]), pa.array(sizes[a:b]),
                     pa.array([data[offsets[i]:offsets[i + 1]] for i in range(a, b)], pa.binary())],
                    ["doc_id", "start", "n_tokens", "ids"])


def segments(spark: SparkSession, path: str) -> DataFrame:
    """The segments of a token folder with ``start``, the number of ids in all earlier ones."""
    s = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    totals = s.groupBy("pid").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("pid", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # one row per written partition: the number of shuffle partitions bounds this side
    return s.join(F.broadcast(bases), "pid").withColumn("start", F.col("base") + F.col("part_start")).drop("base")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of a token folder: doc_id, start (ids of all documents before
    it), n_tokens (with the end id) and ids, as little-endian unsigned 32-bit integers."""
    return segments(spark, path).select("start", "n_nulls", "width", "doc_ids", "ends", "ids").mapInArrow(
        _document_rows, "doc_id long, start long, n_tokens long, ids binary")
