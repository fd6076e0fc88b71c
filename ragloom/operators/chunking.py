"""Chunking (C1-C6): one page row -> many chunk rows.

Separator and recursive splitting are sequential folds over the pieces of one
page, so they run in Arrow batches (pages spread over all tasks), of which a task
splits a bounded number of bytes at a time. Semantic
splitting is page-local too: Spark splits sentences and tokenises them, one Arrow
UDF per batch of pages finds the breaks (no shuffle). The same rules written in
SQL functions (``chunk_semantic_relational``) are kept as a second plan.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from functools import partial
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as TY

from ragloom import constants as C
from ragloom.functions import text as T
from ragloom.operators.embedding import hash_bucket

# ------------------------------------------------------------------ splitter semantics


def _merge(splits: list[str], sep: str, size: int, overlap: int) -> list[str]:
    """Greedy merge: pieces join with ``sep`` while the length stays <= size; a closed
    chunk hands its tail (<= overlap characters) to the next one. Lengths are differences
    of prefix sums, so a piece is looked at a bounded number of times."""
    ends = [0, *accumulate(len(p) + len(sep) for p in splits)]
    out: list[str] = []
    first = 0

    def length(i: int, j: int) -> int:
        return ends[j] - ends[i] - len(sep) if j > i else 0

    def close(j: int) -> None:
        if chunk := sep.join(splits[first:j]).strip():
            out.append(chunk)

    for j in range(len(splits)):
        if first < j and length(first, j + 1) > size:
            close(j)
            while first < j and (length(first, j) > overlap or length(first, j + 1) > size):
                first += 1
    close(len(splits))
    return out


def split_separator(text: str, sep: str = "\n\n", size: int = C.CHUNK_SIZE, overlap: int = C.CHUNK_OVERLAP) -> list[str]:
    """Split on a literal separator (dropped), then merge."""
    pieces = [p for p in (text.split(sep) if sep else list(text)) if p != ""]
    return _merge(pieces, sep, size, overlap)


def _split_keep(text: str, sep: str) -> list[str]:
    """Split keeping each separator at the start of the piece that follows it."""
    if not sep:
        return [c for c in text]
    parts = text.split(sep)
    out = [parts[0]] + [sep + p for p in parts[1:]]
    return [p for p in out if p != ""]


def split_recursive(text: str, size: int = C.CHUNK_SIZE, overlap: int = C.CHUNK_OVERLAP,
                    separators=C.RECURSIVE_SEPARATORS) -> list[str]:
    """First separator present in the text splits it (separators kept); pieces of
    ``size`` characters or more are split again with the remaining separators."""
    sep = separators[-1]
    rest: tuple[str, ...] = ()
    for i, s in enumerate(separators):
        if s == "":
            sep = s
            break
        if s in text:
            sep, rest = s, tuple(separators[i + 1:])
            break
    out: list[str] = []
    good: list[str] = []
    for piece in _split_keep(text, sep):
        if len(piece) < size:
            good.append(piece)
            continue
        if good:
            out.extend(_merge(good, "", size, overlap))
            good = []
        out.extend(split_recursive(piece, size, overlap, rest) if rest else [piece])
    if good:
        out.extend(_merge(good, "", size, overlap))
    return out


# ------------------------------------------------------------------ Spark operators

_CHUNK_COLS = ["source", "page_number"]


PAGES_AT_ONCE = 1 << 20  # bytes of text that a task splits before the chunks leave it


def _split_batches(split, batches):
    for batch in batches:
        texts = batch.column("_text")
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PAGES_AT_ONCE, side="right")))
            found = [split(t) if t is not None else [] for t in texts[i:j].to_pylist()]
            n = np.array([len(f) for f in found])
            kept = batch.drop_columns(["_text"]).take(pa.array(np.repeat(np.arange(i, j), n)))
            index = pa.array(np.concatenate([np.arange(m, dtype=np.int64) for m in n]))
            content = pa.array([c for f in found for c in f], pa.string())
            yield pa.RecordBatch.from_arrays([*kept.columns, index, content], [*kept.schema.names, "chunk_index", "content"])
            i = j


def _split_pages(pages: DataFrame, split, text_col: str, keep: list[str]) -> DataFrame:
    """The chunks of every page, split a bounded number of bytes (or one page) at a time whatever the size of a batch."""
    schema = TY.StructType([*pages.select(*keep).schema.fields, TY.StructField("chunk_index", TY.LongType()), TY.StructField("content", TY.StringType())])
    return pages.select(*keep, F.col(text_col).alias("_text")).mapInArrow(partial(_split_batches, split), schema)


def chunk_separator(pages: DataFrame, sep: str = "\n\n", size: int = C.CHUNK_SIZE, overlap: int = C.CHUNK_OVERLAP,
                    text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """C1 over a page table: ``(source, page_number, chunk_index, content)``."""

    return _split_pages(pages, lambda t: split_separator(t, sep, size, overlap), text_col, keep or _CHUNK_COLS)


def chunk_recursive(pages: DataFrame, size: int = C.CHUNK_SIZE, overlap: int = C.CHUNK_OVERLAP,
                    separators=C.RECURSIVE_SEPARATORS, text_col: str = "text",
                    keep: list[str] | None = None) -> DataFrame:
    """C2 over a page table: ``(source, page_number, chunk_index, content)``."""
    seps = tuple(separators)

    return _split_pages(pages, lambda t: split_recursive(t, size, overlap, seps), text_col, keep or _CHUNK_COLS)


# Sentence boundary: whitespace after '.', '?' or '!' (the whitespace is dropped).
_SENT_END = f"(?<=[.?!]){T.WS}+"


def sentences(pages: DataFrame, text_col: str = "text", keys: list[str] | None = None) -> DataFrame:
    """Sentences of each page: ``(*keys, i, sentence, n_sent)`` with 0-based ``i``."""
    keys = keys or _CHUNK_COLS
    s = pages.select(*keys, F.split(F.col(text_col), _SENT_END, -1).alias("ss"))
    return s.select(*keys, F.size("ss").alias("n_sent"), F.posexplode("ss").alias("i", "sentence"))


def _bucket(tok: str, dim: int, cache: dict) -> int:
    b = cache.get(tok)
    if b is None:
        b = int(hashlib.md5(tok.encode("utf-8")).hexdigest()[:8], 16) % dim
        cache[tok] = b
    return b


def semantic_pieces(sents: list, toks: list, dim: int, percentile: float, buffer: int, cache: dict) -> list:
    """Pieces of one page: hashed token counts per sentence, groups of 2*buffer+1
    neighbouring sentences (prefix sums), cosine distance between consecutive groups,
    break after sentence i where the distance exceeds the page's percentile."""
    n = len(sents)
    if n == 1:
        return [sents[0]]
    counts = np.zeros((n, dim))
    for i, ts in enumerate(toks):
        for t in ts:
            counts[i, _bucket(t, dim, cache)] += 1.0
    pre = np.vstack([np.zeros((1, dim)), np.cumsum(counts, axis=0)])
    g = np.arange(n)
    groups = pre[np.minimum(n, g + buffer + 1)] - pre[np.maximum(0, g - buffer)]
    norm = np.sqrt((groups * groups).sum(axis=1))
    dot = (groups[:-1] * groups[1:]).sum(axis=1)
    ok = (norm[:-1] > 0) & (norm[1:] > 0)
    cos = np.where(ok, dot / np.where(ok, norm[:-1] * norm[1:], 1.0), 0.0)
    d = 1.0 - cos
    brk = d > np.percentile(d, percentile * 100.0)
    pieces, start = [], 0
    for i in np.flatnonzero(brk):
        pieces.append(" ".join(sents[start:i + 1]))
        start = i + 1
    pieces.append(" ".join(sents[start:]))
    return pieces


def chunk_semantic(pages: DataFrame, dim: int = 256, percentile: float = 0.95, buffer: int = 1,
                   text_col: str = "text", keys: list[str] | None = None) -> DataFrame:
    """C3 + C4 (default plan): sentences and their tokens are computed by Spark; one Arrow
    batch of pages at a time, numpy finds each page's pieces. Pages are independent, so
    nothing is shuffled. Same rules as ``chunk_semantic_relational``."""
    keys = keys or _CHUNK_COLS
    sents = F.split(F.col(text_col), _SENT_END, -1)
    toks = F.transform(sents, lambda x: T.tokens(x, fold_accents=False))

    @F.pandas_udf(TY.ArrayType(TY.StringType()))
    def split(ss: pd.Series, ts: pd.Series) -> pd.Series:
        cache: dict = {}
        return pd.Series([semantic_pieces(list(a), [list(t) for t in b], dim, percentile, buffer, cache)
                          for a, b in zip(ss, ts)])

    out = pages.select(*keys, F.posexplode(split(sents, toks)).alias("chunk_index", "content"))
    out = out.where(~T.is_blank("content"))
    return out.select(*keys, F.col("chunk_index").cast("long").alias("chunk_index"), "content")


def _dots(buffer: int) -> str:
    """Products of each sentence's counts with those of itself and the next ``2 * buffer + 1`` ones."""
    return f"""transform(counts, (a, i) -> concat(array(aggregate(map_values(a), 0L, (s, n) -> s + n * n)), transform(
        slice(counts, i + 2, {2 * buffer + 1}), b -> aggregate(array_intersect(map_keys(a), map_keys(b)), 0L, (s, k) -> s + a[k] * b[k]))))"""


def _group_product(step: int, buffer: int) -> str:
    """The product of the counts of sentence groups ``g`` and ``g + step``: the sum over the pairs of their sentences that the page has."""
    pairs = Counter((min(i, j), abs(i - j)) for i in range(-buffer, buffer + 1) for j in range(step - buffer, step + buffer + 1))
    return " + ".join(f"{n}L * coalesce(get(get(dots, g + {i}), {d}), 0L)" for (i, d), n in sorted(pairs.items()))


def chunk_semantic_relational(pages: DataFrame, dim: int = 256, percentile: float = 0.95, buffer: int = 1,
                              text_col: str = "text", keys: list[str] | None = None) -> DataFrame:
    """C3 + C4 in SQL functions: break a page where the cosine distance between neighbouring sentence
    groups (each sentence with ``buffer`` neighbours per side, hashed to ``dim``
    buckets) exceeds the page's ``percentile`` of those distances; join sentences of
    a piece with one space; drop blank pieces. A page of one sentence, or with a null key, stays whole.

    A group is the sum of its sentences, so the products of near sentences' sparse counts give all norms and products of
    groups. All of it stays in the page's row: nothing is exchanged, and its size is that of the page's tokens.
    """
    keys = keys or _CHUNK_COLS
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    p = pages.select(*keys, F.split(F.col(text_col), _SENT_END, -1).alias("ss")).withColumn("n_sent", F.size("ss"))
    buckets = F.transform("ss", lambda x: F.transform(T.tokens(x, fold_accents=False), lambda t: hash_bucket(t, dim).cast("int")))
    p = p.withColumn("buckets", buckets)
    p = p.withColumn("counts", F.expr(
        """transform(buckets, b -> transform(array(array_distinct(b)), k -> map_from_arrays(k, if(size(k) = size(b), array_repeat(1L, size(k)),
        transform(k, x -> bigint(size(b) - size(array_remove(b, x)))))))[0])""")).drop("buckets")
    p = p.withColumn("dots", F.expr(_dots(buffer))).drop("counts")
    # one distance per neighbouring pair (g, g + 1), g < n_sent - 1; zero vectors give cos 0
    p = p.withColumn("norms", F.expr(f"transform(ss, (_, g) -> sqrt(double({_group_product(0, buffer)})))"))
    p = p.withColumn("d", F.expr(f"""transform(slice(ss, 1, greatest(n_sent - 1, 0)), (_, g) -> 1.0D - if(norms[g] > 0 and norms[g + 1] > 0,
        double({_group_product(1, buffer)}) / (norms[g] * norms[g + 1]), 0.0D))""")).drop("dots", "norms")
    # the percentile between the two nearest distances, as ``percentile`` has it
    p = p.withColumn("sorted", F.array_sort("d")).withColumn("at", (F.size("d") - 1) * F.lit(float(percentile)))
    p = p.withColumn("lower", F.expr("if(n_sent > 1, sorted[int(floor(at))], null)")).withColumn("upper", F.expr("if(n_sent > 1, sorted[int(ceil(at))], null)"))
    p = p.withColumn("thr", F.expr("if(lower = upper, lower, (ceil(at) - at) * lower + (at - floor(at)) * upper)"))
    cuts = F.filter(F.transform("d", lambda x, i: F.when(known & (x > F.col("thr")), i + 1)), lambda i: i.isNotNull())
    p = p.select(*keys, "ss", F.concat(F.array(F.lit(0)), cuts, F.array("n_sent")).alias("cuts"))
    pieces = F.expr("transform(slice(cuts, 1, size(cuts) - 1), (x, i) -> array_join(slice(ss, x + 1, cuts[i + 1] - x), ' '))")
    out = p.select(*keys, F.posexplode(pieces).alias("piece", "content")).where(~T.is_blank("content"))
    return out.select(*keys, F.col("piece").cast("long").alias("chunk_index"), "content")


def chunk_stats(chunks: DataFrame, by: tuple[str, ...] = ("source",)) -> DataFrame:
    """Chunks per group with min / average / max length."""
    n = F.length("content")
    return chunks.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_chunks"), F.min(n).cast("long").alias("min_len"),
        F.avg(n).alias("avg_len"), F.max(n).cast("long").alias("max_len"))
