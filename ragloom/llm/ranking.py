"""Ranked lexical search with K2-treaps over blocks of documents.

A block's grid has a row for each term that items ask for (frequent ones first) and a column for each
document; a point is a term in a document with its impact, the part of the score that depends on both.
The grid is a quadtree of which only cells that branch are kept, each with the greatest impact inside.
An item follows the paths of its terms' rows together: a range of documents has one cell for each
term, whose maxima bound the scores in the range. Ranges are opened best first until none can hold a
better document than those found.

Statistics (documents, their lengths, documents with a term) cover the whole table in a pass of their own.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragloom.llm.common import materialize
from ragloom.llm.encoding import text_slices
from ragloom.llm.quality import word_codes, word_places

SLICE = 4_000_000  # bytes of text whose documents are a block, or one document
AT_ONCE = 24  # ranges opened together
ITEM_BYTES = 16 << 20  # text of the items that are searched together
# A-Z become lower case; other ASCII characters that are no letters or digits separate terms
_TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
               for c in range(256))


def terms(data: np.ndarray, offsets: np.ndarray):
    """The terms of texts that lie one after the other: (text of each, its number, the distinct terms)."""
    raw = np.frombuffer(data.tobytes().translate(_TABLE), np.uint8)
    start, size = word_places(raw, offsets)
    codes, distinct = word_codes(raw, start, size)
    return np.searchsorted(offsets, start, side="right") - 1, codes, distinct


# ---- the grid -------------------------------------------------------------------------------

def _spread(x: np.ndarray) -> np.ndarray:
    """Bits of numbers below 2 ** 31, each moved to twice its place."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F),
                        (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


class Treap:
    """Cells by breadth: ``side`` (log2 of the side; 0 for a point), ``row`` and ``column`` of a point inside, the
    greatest ``impact`` inside, and ``child`` numbers by quadrant (2 * lower half of rows + right half of
    columns). The last cell stands for an empty quadrant."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, impacts: np.ndarray):
        """Of points that differ in row or column, at least one."""
        code = (_spread(rows) << np.uint64(1)) | _spread(columns)
        order = np.argsort(code, kind="stable")
        code, rows, columns, impacts = code[order], rows[order], columns[order], impacts[order]
        low, high = np.zeros(1, np.int64), np.full(1, len(code))
        lows, sides, children, tops = [], [], [], []
        n = 1  # cells numbered so far
        while len(low):
            differ = code[low] ^ code[high - 1]
            side = np.zeros(len(low), np.int64)
            many = differ > 0
            # half the number of bits from the first that differs on, rounded up
            side[many] = (np.frexp(differ[many].astype(np.float64))[1] + 1) // 2
            # a float's exponent may be one too high just below a power of two; then the lower side holds them too
            over = many & (side > 0) & ((differ >> np.maximum(2 * side - 2, 0).astype(np.uint64)) == 0)
            side[over] -= 1
            lows.append(low)
            sides.append(side)
            ends = np.empty(2 * len(low), np.int64)
            ends[::2], ends[1::2] = low, high
            tops.append(np.maximum.reduceat(np.append(impacts, 0), ends)[::2])
            child = np.full((len(low), 4), -1, np.int64)
            inner = np.flatnonzero(many)
            if len(inner):
                step = (2 * (side[inner] - 1)).astype(np.uint64)
                first = (code[low[inner]] >> (step + np.uint64(2))) << np.uint64(2)
                cuts = [low[inner], *(np.searchsorted(code, (first | np.uint64(q)) << step) for q in (1, 2, 3)), high[inner]]
                cuts = np.stack([np.clip(c, low[inner], high[inner]) for c in cuts], axis=1)
                full = cuts[:, 1:] > cuts[:, :-1]
                child[inner] = np.where(full, n + np.cumsum(full).reshape(full.shape) - 1, -1)
                low, high = cuts[:, :-1][full], cuts[:, 1:][full]
                n += len(low)
            else:
                low = high = np.zeros(0, np.int64)
            children.append(child)
        at = np.concatenate(lows)
        self.side = np.append(np.concatenate(sides), -1)
        self.row, self.column = np.append(rows[at], 0), np.append(columns[at], 0)
        self.impact = np.append(np.concatenate(tops), 0)
        child = np.concatenate(children)
        self.child = np.append(np.where(child < 0, n, child), np.full((1, 4), n), axis=0)
        self.empty = n

    def best(self, rows: np.ndarray, weights: np.ndarray, k: int, least: int) -> list[tuple[int, int]]:
        """(score, column) of the documents whose score, the sum of weight times impact over ``rows``, is among
        the ``k`` highest and at least ``least``, and of all with the same score as the k-th."""
        top = int(self.side[0])
        cells = np.zeros((1, len(rows)), np.int64)
        cells[0, (self.row[0] >> top) != (rows >> top)] = self.empty
        heap = [(-int((weights * self.impact[cells[0]]).sum()), 0, top, int(self.column[0]) >> top, cells[0])]
        found: list[tuple[int, int]] = []
        scores: list[int] = []  # the k highest, least first
        pushed = 0
        while heap and -heap[0][0] >= least and heap[0][0] < 0:
            opened = [heapq.heappop(heap) for _ in range(min(AT_ONCE, len(heap))) if -heap[0][0] >= least and heap[0][0] < 0]
            for bound, _, side, column, _ in opened:
                if side == 0:
                    found.append((-bound, column))
                    heapq.heappush(scores, -bound)
                    if len(scores) > k:
                        heapq.heappop(scores)
                    if len(scores) == k:
                        least = max(least, scores[0])
            wide = [o for o in opened if o[2] > 0]
            if not wide:
                continue
            cells = np.array([o[4] for o in wide])
            side = np.array([o[2] for o in wide])[:, None]
            column = np.array([o[3] for o in wide])
            own = self.side[cells]
            lower = (rows[None, :] >> (side - 1)) & 1
            right = (self.column[cells] >> (side - 1)) & 1  # of cells that are smaller than the range
            for half in (0, 1):
                below = np.where(own == side, self.child[cells, 2 * lower + half], np.where((own >= 0) & (right == half), cells, self.empty))
                level = np.maximum(self.side[below], 0)
                below[(self.row[below] >> level) != (rows[None, :] >> level)] = self.empty
                bounds = (weights[None, :] * self.impact[below]).sum(axis=1)
                for i in np.flatnonzero((bounds >= least) & (bounds > 0)).tolist():
                    pushed += 1
                    heapq.heappush(heap, (-int(bounds[i]), pushed, int(side[i, 0]) - 1, 2 * int(column[i]) + half, below[i]))
        return [f for f in found if f[0] >= least]


# ---- Spark ---------------------------------------------------------------------------------

def _statistic_rows(wanted):
    """Batches of texts -> (row of a term or -1, documents with it or with any term, terms in all)."""

    def rows(batches):
        asked = pa.array(wanted.value, pa.large_binary())
        held, n, total = np.zeros(len(asked), np.int64), 0, 0
        for batch in batches:
            for data, offsets in text_slices(batch.column(0), SLICE):
                owner, codes, distinct = terms(data, offsets)
                row = pc.fill_null(pc.index_in(distinct, value_set=asked), -1).to_numpy()[codes]
                n, total = n + len(np.unique(owner)), total + len(owner)
                use = row >= 0
                held += np.bincount(np.unique(owner[use] * len(asked) + row[use]) % max(1, len(asked)), minlength=len(asked))
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(held[at], n)),
                                          pa.array(np.append(np.zeros(len(at), np.int64), total))], ["row", "n", "total"])

    return rows


def impacts(tf: np.ndarray, length: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """A term's part of the score in documents of some length, without its weight."""
    m = 75 + (25 * length * n_docs) // n_terms
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def _hit_rows(plan, k: int):
    """Batches of (doc id, text) -> each item's best documents of a task: (item, doc id, score)."""

    def rows(batches):
        p = plan.value
        asked = pa.array(p["terms"], pa.large_binary())
        best: list[list[tuple]] = [[] for _ in p["items"]]
        for batch in batches:
            ids, done = batch.column(0).to_pylist(), 0
            for data, offsets in text_slices(batch.column(1), SLICE):
                own = ids[done:done + len(offsets) - 1]
                done += len(own)
                owner, codes, distinct = terms(data, offsets)
                row = pc.fill_null(pc.index_in(distinct, value_set=asked), -1).to_numpy()[codes]
                use = row >= 0
                if not use.any():
                    continue
                length = np.bincount(owner, minlength=len(own))
                key, tf = np.unique(owner[use] * len(asked) + row[use], return_counts=True)
                column, row = key // len(asked), key % len(asked)
                treap = Treap(row, column, impacts(tf, length[column], p["n_docs"], p["n_terms"]))
                there = np.zeros(len(asked), bool)
                there[row] = True
                for i, (item_rows, weights) in enumerate(p["items"]):
                    mine = there[item_rows]
                    if not mine.any():
                        continue
                    least = best[i][-1][0] if len(best[i]) == k else 1
                    new = [(s, own[c]) for s, c in treap.best(item_rows[mine], weights[mine], k, least)]
                    if new:  # null ids last
                        best[i] = sorted(best[i] + new, key=lambda h: (-h[0], h[1] is None, h[1] or 0))[:k]
        out = [(i, d, s) for i, hits in enumerate(best) for s, d in hits]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["at", "doc_id", "score"])

    return rows


def _block(items: pa.Table):
    """Distinct terms of some items, and each item's (numbers of its terms, times)."""
    data, offsets = next(text_slices(items.column("text").combine_chunks(), 1 << 62))
    owner, codes, distinct = terms(data, offsets)
    key, times = np.unique(owner * max(1, len(distinct)) + codes, return_counts=True)
    owner, codes = key // max(1, len(distinct)), key % max(1, len(distinct))
    bounds = np.searchsorted(owner, np.arange(len(offsets)))
    return distinct.to_pylist(), [(codes[a:b], times[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]


def _search_block(texts: DataFrame, items: pa.Table, k: int) -> DataFrame | None:
    sc = texts.sparkSession.sparkContext
    distinct, own = _block(items)
    if not distinct:
        return None
    rows = texts.select("text").mapInArrow(_statistic_rows(sc.broadcast(distinct)), "row long, n long, total long")
    held, n_docs, n_terms = np.zeros(len(distinct), np.int64), 0, 0
    for r in rows.groupBy("row").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():  # a row for each term asked for
        if r.row < 0:
            n_docs, n_terms = r.n, r.total
        else:
            held[r.row] = r.n
    if not n_terms:
        return None
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(df) + 1))) for df in held], np.int64)
    order = np.lexsort((np.arange(len(held)), -held))  # frequent terms first: rows of rare ones have sparse cells
    place = np.empty(len(held), np.int64)
    place[order] = np.arange(len(held))
    plan = sc.broadcast({"terms": [distinct[i] for i in order], "n_docs": n_docs, "n_terms": n_terms,
                         "items": [(place[codes], weight[codes] * times) for codes, times in own]})
    hits = texts.mapInArrow(_hit_rows(plan, k), "at long, doc_id long, score long")
    # the block's items, whose texts ITEM_BYTES bounds
    rows = texts.sparkSession.createDataFrame(items.append_column("at", pa.array(range(len(items)), pa.int64())).select(["at", "row", "item_id"]))
    return hits.join(F.broadcast(rows), "at").drop("at")


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text_col: str = "text", item_bytes: int = ITEM_BYTES) -> DataFrame:
    """The ``k`` highest-scoring documents of all for each row of ``items``: row (numbers the items' rows), item_id,
    rank (from 1), doc_id, score (above 0); equal scores by ascending doc_id, nulls last.

    Items are searched in blocks of some ``item_bytes`` of text (or one item), which bounds what the driver
    and the tasks hold of them; each block reads the documents twice, once for the statistics. A task keeps
    k documents for each item, so only those are exchanged. Null and empty texts hold no term and are
    not found; items without terms have no rows; repeated rows are found and ranked each for itself; other
    columns are ignored; empty tables give no rows.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    asked = items.select(F.col(item_col).alias("item_id"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text"))
    asked = materialize(asked.withColumn("row", F.monotonically_increasing_id()).withColumn("size", F.octet_length("text") + 16))
    n_blocks = 1 + (asked.agg(F.sum("size")).first()[0] or 0) // item_bytes
    out = None
    for b in range(n_blocks):
        part = asked.where(F.pmod(F.xxhash64("row"), F.lit(n_blocks)) == b).select("row", "item_id", "text").toArrow()
        if len(part) and (found := _search_block(texts, part, k)) is not None:
            out = found if out is None else out.unionByName(found)
    if out is None:
        out = asked.limit(0).select(F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"), "row", "item_id")
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("row", "item_id", "rank", "doc_id", "score")
