"""Benchmark decontamination by winnowing.

Words of training and test texts are hashed, then all runs of ``K`` words. Of every window of
consecutive run hashes (together ``window`` words) the least one is kept as a fingerprint, the
rightmost of equal ones. A span of ``window`` words that both texts have holds the same run
hashes, so both keep the same one: every shared span of that length has a common fingerprint.
Fingerprints are joined, and each hit is extended word by word to both sides; it counts if
the equal stretch reaches the window length. Test items shorter than a window are one
fingerprint each, and are looked up among the training texts' runs of that length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragloom.llm.common import fresh, materialize, text_bytes
from ragloom.llm.encoding import grouped

WINDOW, K = 13, 5
FILTER_BITS = 20
MAX_WORDS = 100_000  # words whose hashes a task keeps
# ASCII bytes that are neither letters nor digits separate words; A-Z become lower case
_TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
               for c in range(256))
_MIX = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_HIT = "array<struct<hash:bigint,x:bigint,lead:int,need:int,context:string>>"
_HIT_TYPE = pa.list_(pa.struct([("hash", pa.int64()), ("x", pa.int64()), ("lead", pa.int32()), ("need", pa.int32()),
                                ("context", pa.string())]))


def words(text: bytes | None) -> list[bytes]:
    """The words of a text: lower-cased runs of ASCII letters, digits and all other characters."""
    return text.translate(_TABLE).split() if text else []


class _Hashes(dict):
    """Hashes of words a task has seen before, in bounded memory."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) > MAX_WORDS:
                self.clear()
            self[word] = h
        return h


def run_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of ``k`` words, from the words' hashes."""
    n = max(0, len(hashes) - k + 1)
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out = (out ^ hashes[j:j + n]) * _MIX[0]
        out ^= out >> np.uint64(29)
    out *= _MIX[1]
    return out ^ (out >> np.uint64(32))


def kept(grams: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, window: int, k: int) -> np.ndarray:
    """Which run hashes at the places ``at`` are kept: the rightmost least one of a window that
    lies in the text, whose words are numbered from ``low`` up to ``high``."""
    span = window - k  # a window has so many further run hashes
    pad = np.concatenate([np.zeros(span, np.uint64), grams, np.zeros(span, np.uint64)])
    own, x = grams[at], at + span
    left, right = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    more_left, more_right = np.ones(len(at), bool), np.ones(len(at), bool)
    for j in range(1, span + 1):
        more_left &= pad[x - j] >= own
        more_right &= pad[x + j] > own
        left += more_left
        right += more_right
    first = np.maximum(low, at - left)
    last = np.minimum(np.minimum(at, high - window), at + right - span)
    return first <= last


def _hits(texts: list[list[bytes]], window: int, k: int, wanted, known: _Hashes) -> list[list[tuple]]:
    """For each text its fingerprints (hash, place, words before it in the context, equal words
    needed, context). ``wanted`` is None for test items, whose fingerprints are all given; else
    (marks of the test items' hashes, lengths of short items)."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    hashes = np.fromiter((known[w] for t in texts for w in t), np.uint64, int(ends[-1]) if len(ends) else 0)
    owner = np.repeat(np.arange(len(texts)), sizes)
    out: list[list[tuple]] = [[] for _ in texts]
    mask = np.uint64((1 << FILTER_BITS) - 1)

    def add(i, x, gram, a, b, need):
        t, s = texts[i], int(starts[i])
        out[i].append((int(gram.astype(np.int64)), x - s, x - a, need, b" ".join(t[a - s:b - s]).decode()))

    grams = run_hashes(hashes, k)
    at = np.arange(len(grams)) if wanted is None else np.flatnonzero(wanted[0][grams & mask])
    low, high = starts[owner[at]], ends[owner[at]]
    for x, a, b in zip(*(v[kept(grams, at, low, high, window, k)].tolist() for v in (at, low, high))):
        add(owner[x], x, grams[x], max(a, x - (window - k)), min(b, x + window), window)
    short = {int(n) for n in sizes if 0 < n < window} if wanted is None else wanted[1]
    for n in short:
        grams = run_hashes(hashes, n) ^ _MIX[2]
        if wanted is None:
            at = starts[sizes == n]
        else:
            at = np.flatnonzero(wanted[0][grams & mask])
            at = at[at + n <= ends[owner[at]]]
        for x in at.tolist():
            add(owner[x], x, grams[x], x, x + n, n)
    return out


def _fingerprint_rows(window: int, k: int, wanted, names: list[str]):
    """Batches whose last column is the text -> the other columns, n_words, fingerprints."""

    def rows(batches):
        marks, known = None if wanted is None else wanted.value, _Hashes()
        for batch in batches:
            texts = text_bytes(batch.column(batch.num_columns - 1))
            n_words, found = [], []
            for a, b in grouped([t or b"" for t in texts]):
                split = [words(t) for t in texts[a:b]]
                n_words += [len(t) for t in split]
                found += _hits(split, window, k, marks, known)
            found = [[dict(zip(("hash", "x", "lead", "need", "context"), h)) for h in f] for f in found]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n_words, pa.int64()), pa.array(found, _HIT_TYPE)],
                                             [*names, "n_words", "hits"])

    return rows


def _extended_rows(batches):
    """Joined fingerprints -> the stretches of equal words that are long enough."""
    for batch in batches:
        c = [batch.column(n).to_pylist() for n in ("x", "lead", "context", "lead_b", "context_b", "need")]
        keep, low, high = [], [], []
        for i, (x, lead, context, lead_b, context_b, need) in enumerate(zip(*c)):
            d, t = context.split(" "), context_b.split(" ")
            left = right = 0
            while left < min(lead, lead_b) and d[lead - 1 - left] == t[lead_b - 1 - left]:
                left += 1
            most = min(len(d) - lead, len(t) - lead_b)
            while right < most and d[lead + right] == t[lead_b + right]:
                right += 1
            if left + right >= need:
                keep.append(i), low.append(x - left), high.append(x + right)
        at = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("row").take(at), batch.column("context_id").take(at),
                                          pa.array(low, pa.int64()), pa.array(high, pa.int64())],
                                         ["row", "context_id", "low", "high"])


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, k: int = K,
                  share: int = 20) -> DataFrame:
    """Per row of ``docs``: its id (doc_id), text_hash (xxhash64 of the text), n_words, n_hit (words
    inside an occurrence of a window of an item), items (ids of items with occurring windows, as
    strings, sorted), contaminated (``n_hit > 0 and share * n_hit >= n_words``).

    The texts are read once and never shuffled: only fingerprints whose hash has its mark set
    leave that pass, with their context of at most ``2 * window`` words. The marks of the test
    items' hashes are a bit string of fixed size (2 ** FILTER_BITS) whatever the benchmark's. The
    join on the hash, of fingerprints and distinct contexts of the test items, is Spark's to
    plan by measured size; AQE splits a passage that many documents share. Null and empty
    texts have no words and no hits; repeated rows are judged one by one; items of null id mark
    words but are not listed; other columns are ignored.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col)).mapInArrow(
        _fingerprint_rows(window, k, None, ["item"]), f"item string, n_words long, hits {_HIT}")
    items = materialize(items.select("item", F.inline("hits")).drop("x").withColumn(
        "context_id", F.xxhash64("hash", "context", "lead", "need")))
    contexts = items.select("hash", "context_id", F.col("lead").alias("lead_b"), F.col("context").alias("context_b"),
                            "need").distinct()
    owners = items.where("item is not null").select("context_id", "item").distinct()
    marks = np.zeros(1 << FILTER_BITS, bool)
    places = items.select(F.col("hash").bitwiseAND((1 << FILTER_BITS) - 1).alias("p")).distinct()  # at most 2 ** FILTER_BITS
    marks[places.toArrow().column("p").to_numpy()] = True
    short = {r.need for r in items.select("need").where(F.col("need") < window).distinct().collect()}  # fewer than ``window``
    wanted = spark.sparkContext.broadcast((marks, short))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col))
    rows = rows.mapInArrow(_fingerprint_rows(window, k, wanted, ["doc_id", "text_hash"]),
                           f"doc_id long, text_hash long, n_words long, hits {_HIT}")
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()))

    joined = rows.where(F.size("hits") > 0).select("row", F.inline("hits")).join(contexts, ["hash", "need"])
    stretches = joined.select("row", "context_id", "x", "lead", "context", "lead_b", "context_b", "need").mapInArrow(
        _extended_rows, "row long, context_id long, low long, high long")
    stretches = materialize(stretches)
    before = Window.partitionBy("row").orderBy("low", "high").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.max("high").over(before), F.col("low"))
    hit = stretches.select("row", "low", "high").distinct().withColumn("seen", seen).groupBy("row").agg(
        F.sum(F.greatest(F.lit(0), F.col("high") - F.greatest("low", "seen"))).alias("n_hit"))
    listed = stretches.select("row", "context_id").distinct().join(owners, "context_id").groupBy("row").agg(
        F.array_sort(F.collect_set("item")).alias("items"))
    out = rows.drop("hits").join(hit.join(listed, "row", "left"), "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    return out.select("doc_id", "text_hash", "n_words", n_hit.alias("n_hit"),
                      F.coalesce("items", F.array().cast("array<string>")).alias("items"),
                      ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                        **options) -> DataFrame:
    """The rows of ``docs``, all columns, that are not contaminated. The decision depends on the
    text alone, so rows are matched by their id and text hash, repeated rows alike."""
    key, h = fresh(docs, "_key", "_hash")
    bad = contamination(docs, benchmark, id_col, text_col, **options).where("contaminated").select(
        F.col("doc_id").alias(key), F.col("text_hash").alias(h)).distinct()
    return docs.join(bad, F.col(id_col).cast("long").eqNullSafe(F.col(key)) & (F.xxhash64(text_col) == F.col(h)), "left_anti")
