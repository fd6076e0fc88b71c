"""Best-fit packing of token pieces into sequences, after Martello and Toth's reduction.

A piece's size is at most the capacity, so a histogram of sizes (capacity + 1 numbers,
whatever the corpus) states the whole instance. The driver plans on that histogram: it
permanently fixes bins that dominate every other bin for their largest piece, then packs the
rest by best fit, largest first; it yields patterns (sizes in a bin) with the number of
bins each. Spark tasks then deal out the pieces by their rank among pieces of equal size.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragloom.llm.common import materialize
from ragloom.llm.encoding import encode_column, encoder, load_spec

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


# ---- planning on the histogram ------------------------------------------------------------

def _largest(left: np.ndarray, most: int) -> int:
    """The largest size up to ``most`` that is left, 0 if none."""
    there = np.flatnonzero(left[: most + 1])
    return int(there[-1]) if len(there) and there[-1] > 0 else 0


def _smallest(left: np.ndarray, k: int) -> list[int]:
    out: list[int] = []
    for s in np.flatnonzero(left):
        out += [int(s)] * min(k - len(out), int(left[s]))
        if len(out) == k:
            break
    return out


def dominating_set(counts: np.ndarray, j: int, capacity: int) -> tuple[int, ...] | None:
    """Sizes of a bin with a piece of size ``j`` that dominates all its other feasible bins,
    of at most three pieces; None where the criterion finds none.

    One bin dominates another if the other's pieces can be dealt into groups that each are
    no larger than an own piece of the one: exchanging them never needs a further bin.
    """
    room = capacity - j
    left = counts.copy()
    left[j] -= 1
    best = _largest(left, room)
    if not best:
        return (j,)  # nothing fits beside it
    if best == room:
        return j, best  # whatever else would fit beside j also fits in the place of best
    small = _smallest(left, 3)
    if len(small) < 2 or small[0] + small[1] > room:
        return j, best  # one piece at most fits beside it: the largest is the best
    if len(small) == 3 and sum(small) <= room:
        return None  # three or more fit: undecided
    # at most two fit beside it: all pairs (a, b), a >= b, by the largest b for each a
    a = np.flatnonzero(left[: room + 1])
    a = a[a > 0]
    at_most = np.minimum(a, room - a)
    place = np.searchsorted(a, at_most, side="right") - 1
    b = np.where(place >= 0, a[np.maximum(place, 0)], 0)
    alone = (b == a) & (left[a] < 2)  # a pair of equal sizes needs two of them
    b = np.where(alone, np.where(place >= 1, a[np.maximum(place - 1, 0)], 0), b)
    if (np.where(b > 0, a + b, 0) <= best).all():
        return j, best  # best takes any pair's place
    left[best] -= 1
    second = _largest(left, room - best)
    # (best, second) dominates a pair whose smaller piece fits in second, or that fits in best as a whole
    if second and ((b <= second) | (a + b <= best)).all():
        return j, best, second
    return None


def reduce(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fix dominating bins, many at a time, until none is found; takes them off ``counts``."""
    fixed = []
    found = True
    while found:
        found = False
        for j in range(capacity, 0, -1):
            while counts[j] > 0 and (bin_ := dominating_set(counts, j, capacity)):
                need = np.bincount(bin_, minlength=capacity + 1)
                used = np.flatnonzero(need)
                # while these sizes last, fewer other pieces only remove bins to dominate
                times = int((counts[used] // need[used]).min())
                counts[used] -= need[used] * times
                fixed.append((tuple(sorted(bin_, reverse=True)), times))
                found = True
    return fixed


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Best fit by decreasing size. Bins of equal content are handled together; as a piece
    put into the fullest bin that has room makes it fuller still, each bin takes as many of
    the size as it holds before the next one does."""
    open_: dict[int, list] = {}  # room left -> [(content, bins)]

    def put(room, content, bins):
        if bins:
            open_.setdefault(room, []).append((content, bins))

    for s in range(capacity, 0, -1):
        left = int(counts[s])
        while left:
            room = min((r for r in open_ if r >= s), default=None)
            if room is None:
                room, content, bins = capacity, (), left
            else:
                content, bins = open_[room].pop()
                if not open_[room]:
                    del open_[room]
            new = not content
            each = room // s
            full = min(bins, left // each)
            put(room - each * s, content + ((s, each),), full)
            left -= full * each
            bins -= full
            if left and bins and left < each:
                put(room - left * s, content + ((s, left),), 1)
                left, bins = 0, bins - 1
            if not new:
                put(room, content, bins)
    return [x for group in open_.values() for x in group]


def plan(counts: np.ndarray, capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Patterns ((size, how many), ...) with their numbers of bins, for pieces counted by size."""
    counts = counts.astype(np.int64).copy()
    out = []
    for sizes, times in reduce(counts, capacity):
        runs: dict[int, int] = {}
        for s in sizes:
            runs[s] = runs.get(s, 0) + 1
        out.append((tuple(runs.items()), times))
    return out + best_fit(counts, capacity)


def slots(patterns, capacity: int) -> dict[int, np.ndarray]:
    """For each size the rows (first rank, pieces per bin, first bin, offset of the first piece),
    by rank. Their number is bounded by the capacity: patterns times sizes in one of them."""
    seen = np.zeros(capacity + 1, np.int64)
    rows: dict[int, list] = {}
    bin_ = 0
    for pattern, times in patterns:
        offset = 0
        for s, q in pattern:
            rows.setdefault(s, []).append((seen[s], q, bin_, offset))
            seen[s] += q * times
            offset += s * q
        bin_ += times
    return {s: np.array(r, np.int64) for s, r in rows.items()}


# ---- Spark ---------------------------------------------------------------------------------

def _piece_rows(spec, end_id: int, capacity: int, keep_ids: bool):
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * keep_ids

    def rows(batches):
        enc = encoder(spec.value)
        for batch in batches:
            keys, out = batch.column(0).to_pylist(), [[] for _ in names]
            for key, found in zip(keys, encode_column(enc, batch.column(1))):
                ids = np.empty(len(found) + 1, "<u4")
                ids[:-1], ids[-1] = found, end_id
                # the first piece takes what whole pieces leave
                first = len(ids) % capacity or capacity
                cuts = [0, *range(first, len(ids) + 1, capacity)]
                for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    data = ids[a:b].tobytes()
                    for c, v in zip(out, (key, i, a, b - a, zlib.crc32(data), data)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)

    return rows


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int, id_col: str = "doc_id",
                 text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """The ids of every text (null: empty) and ``end_id``, cut into pieces of ``capacity`` if longer;
    the first piece is the shorter one. ``keep_ids`` adds the ids as little-endian unsigned 32-bit
    integers. No exchange; repeated rows give repeated pieces; other columns are ignored."""
    spec = docs.sparkSession.sparkContext.broadcast(load_spec(tokenizer_path))
    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(
        _piece_rows(spec, end_id, capacity, keep_ids), PIECE_SCHEMA + (", ids binary" if keep_ids else ""))


def _stamp(length_at: int):
    """Adds the partition, and the rank among its pieces of equal size."""

    def rows(batches):
        pid, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            sizes = batch.column(length_at).to_numpy(zero_copy_only=False)
            order = np.argsort(sizes, kind="stable")
            rank = np.empty(len(sizes), np.int64)
            values, starts, counts = np.unique(sizes[order], return_index=True, return_counts=True)
            for v, a, n in zip(values.tolist(), starts.tolist(), counts.tolist()):
                rank[order[a:a + n]] = seen.get(v, 0) + np.arange(n)
                seen[v] = seen.get(v, 0) + n
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(sizes), pid, np.int32)), pa.array(rank)],
                                             [*batch.schema.names, "_pid", "_rank"])

    return rows


def _assign(table, columns: list[str]):
    def rows(batches):
        slots_ = table.value
        for batch in batches:
            sizes = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("_rank").to_numpy(zero_copy_only=False)
            seq, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
            for s in np.unique(sizes).tolist():
                mine = np.flatnonzero(sizes == s)
                t = slots_[s]
                at = t[np.searchsorted(t[:, 0], rank[mine], side="right") - 1]
                nth, q = rank[mine] - at[:, 0], at[:, 1]
                seq[mine], offset[mine] = at[:, 2] + nth // q, at[:, 3] + nth % q * s
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(seq), pa.array(offset)],
                                             [*columns, "sequence_id", "offset"])

    return rows


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Place every piece (column ``length``, 1 to ``capacity``) in a sequence: adds ``sequence_id``
    (from 0) and ``offset`` (gapless from 0 in each sequence) to the other columns.

    The stamped pieces are written once (a rank must not change when a task runs again).
    The driver gets the histogram of sizes, ``capacity`` numbers, and broadcasts the slots, whose
    number the capacity bounds. Hot sizes are numbered per partition, so no size gathers
    in one task. An empty table gives an empty result.
    """
    spark, columns = pieces.sparkSession, pieces.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    stamped = materialize(pieces.mapInArrow(_stamp(columns.index("length")), schema + ", _pid int, _rank long"))
    per_part = stamped.groupBy("length", "_pid").agg(F.count(F.lit(1)).alias("_n"))
    counts = np.zeros(capacity + 1, np.int64)
    for r in per_part.groupBy("length").agg(F.sum("_n").alias("n")).collect():  # at most ``capacity`` rows
        counts[r["length"]] = r["n"]
    before = Window.partitionBy("length").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_part.select("length", "_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    ranked = stamped.join(bases, ["length", "_pid"]).withColumn("_rank", F.col("_base") + F.col("_rank"))
    table = spark.sparkContext.broadcast(slots(plan(counts, capacity), capacity))
    return ranked.select(*columns, "_rank").mapInArrow(
        _assign(table, columns), schema + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int, id_col: str = "doc_id",
                   text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """``token_pieces`` and ``pack`` in one."""
    return pack(token_pieces(docs, tokenizer_path, end_id, capacity, id_col, text_col, keep_ids), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves (``keep_ids``): sequence_id, n_tokens, ids; a group is
    bounded by the capacity."""
    held = packed.groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"),
        F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("ids")))).alias("parts"))
    return held.select("sequence_id", "n_tokens",
                       F.unhex(F.array_join(F.col("parts.ids"), "")).alias("ids"))
