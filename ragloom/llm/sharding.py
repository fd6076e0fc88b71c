"""Sharding by histogram sort: shards of near equal bytes, found by counting alone.

Rows are ordered by a key: the text's hash, then the id, so equal texts stand together and still
can be divided where one text has more bytes than a shard. Splitters are found on the narrow
rows (key, size): each round counts the exact bytes below candidate boundaries in all partitions,
first of the whole key range, then inside the intervals where a splitter's target still lies, until
each splitter has a boundary within the tolerance. Only then the rows are exchanged, once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragloom.llm.common import fresh, materialize

PROBE_BITS = 8  # candidate boundaries of a round in an interval: 2 ** PROBE_BITS
TOLERANCE = 0.0005  # of a shard's bytes, at each splitter
GROUP_ROWS = 20_000  # rows numbered together, roughly
SIGN = 1 << 63


def _flipped(c) -> Column:
    return F.col(c).bitwiseXOR(F.lit(-SIGN))  # now ordered as unsigned


def _digits(start: int) -> Column:
    """``PROBE_BITS`` bits of the 128-bit key (h, i) after the first ``start``."""
    part, at = (_flipped("h"), start) if start < 64 else (_flipped("i"), start - 64)
    return F.shiftrightunsigned(part, 64 - at - PROBE_BITS).bitwiseAND((1 << PROBE_BITS) - 1)


def _prefix(start: int) -> tuple[Column, Column]:
    """The first ``start`` bits of the key, as two numbers."""
    zero = F.lit(0).cast("long")
    if start < 64:
        return (F.shiftrightunsigned(_flipped("h"), 64 - start) if start else zero), zero
    return _flipped("h"), (F.shiftrightunsigned(_flipped("i"), 128 - start) if start > 64 else zero)


def _prefix_of(p: int, start: int) -> tuple[int, int]:
    if start < 64:
        return p, 0
    high = p >> (start - 64)
    return high - (1 << 64) if high >> 63 else high, p & ((1 << (start - 64)) - 1)


def _signed(x: int) -> int:
    return (x ^ SIGN) - (1 << 64) if x ^ SIGN >= SIGN else x ^ SIGN


def splitters(keys: DataFrame, n_shards: int, tolerance: float = TOLERANCE) -> tuple[list[tuple[int, int]], int]:
    """Keys (h, i) at which the shards after the first begin, and the number of rows.

    ``keys`` has columns h, i (the key), size, and is read once a round. The driver gets
    at most 2 ** PROBE_BITS sums for each pair of intervals and round; there are at most 16 rounds, and
    fewer unless one hash has more bytes than the tolerance. Rows of equal key are not divided.
    """
    total = keys.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("s"), F.count(F.lit(1)).alias("n")).first()
    targets = {j: total.s * j / n_shards for j in range(1, n_shards)}
    slack = tolerance * total.s / n_shards
    found: dict[int, int] = {}
    open_: dict[int, tuple[int, int]] = {j: (0, 0) for j in targets}  # splitter -> (prefix, bytes below its interval)
    start = 0
    while open_:
        high, low = _prefix(start)
        at = {_prefix_of(p, start): p for p, _ in open_.values()}
        rows = keys.select(high.alias("a"), low.alias("b"), _digits(start).alias("digit"), "size")
        rows = rows.where(F.col("a").isin([a for a, _ in at]) & F.col("b").isin([b for _, b in at]))
        sums: dict[int, dict[int, int]] = {}
        for r in rows.groupBy("a", "b", "digit").agg(F.sum("size").alias("s")).collect():
            if (r.a, r.b) in at:
                sums.setdefault(at[r.a, r.b], {})[r.digit] = r.s
        start += PROBE_BITS
        still = {}
        for j, (p, below) in open_.items():
            counts, candidates = sums.get(p, {}), []
            for d in range(1 << PROBE_BITS):
                candidates.append((abs(below - targets[j]), p << PROBE_BITS | d))
                inside = counts.get(d, 0)
                if below + inside > targets[j]:
                    still[j] = (p << PROBE_BITS | d, below)
                    below += inside
                    candidates.append((abs(below - targets[j]), (p << PROBE_BITS | d) + 1))
                    break
                below += inside
            miss, boundary = min(candidates)
            if j not in still or miss <= slack or start == 128:
                still.pop(j, None)
                found[j] = boundary << (128 - start)
        open_ = still
    bounds = [min(found[j], (1 << 128) - 1) for j in sorted(found)]
    return [(_signed(b >> 64), _signed(b & ((1 << 64) - 1))) for b in bounds], total.n


def shard_documents(docs: DataFrame, n_shards: int = 40, tolerance: float = TOLERANCE, overhead: int = 16,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds size (UTF-8 bytes of the text, null has none, and ``overhead``), shard (from 0) and slot
    (gapless from 0 in each shard) to the rows, under names that are still free, in this order.

    Shards' sizes differ by the tolerance and one row's size, unless rows of equal id and text,
    which stay together, have more. A slot is the place in a small group of a shard's rows plus the
    rows of the groups before it, so neither a shard nor a hot text gathers in one task; the one
    exchange is by these groups. Null ids order first; an empty table gives an empty result.
    """
    size, shard, slot = fresh(docs, "size", "shard", "slot")
    h, i, group, base = fresh(docs, "_h", "_i", "_group", "_base")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.withColumns({size: (F.octet_length(text) + overhead).cast("long"), h: F.xxhash64(text),
                             i: F.coalesce(F.col(id_col).cast("long"), F.lit(-SIGN))})
    keys = materialize(rows.select(F.col(h).alias("h"), F.col(i).alias("i"), F.col(size).alias("size")))
    bounds, n = splitters(keys, n_shards, tolerance)
    groups = max(8, -(-n // (n_shards * GROUP_ROWS)))

    def dealt(df, a, b):
        below = [((F.col(a) > x) | ((F.col(a) == x) & (F.col(b) >= y))).cast("int") for x, y in bounds]
        return df.withColumns({shard: sum(below, F.lit(0)), group: F.pmod(F.xxhash64(a, b), F.lit(groups)).cast("int")})

    counts = dealt(keys, "h", "i").groupBy(shard, group).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(shard).orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(shard, group, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(base))
    place = F.row_number().over(Window.partitionBy(shard, group).orderBy(h, i))
    placed = dealt(rows, h, i).withColumn(slot, place.cast("long") - 1).join(bases, [shard, group])
    return placed.select(*docs.columns, size, shard, (F.col(slot) + F.col(base)).alias(slot))


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """``shard_documents``, written as Parquet with a folder for each shard."""
    out = shard_documents(docs, **options)
    out.write.partitionBy(out.columns[-2]).mode("errorifexists").parquet(path)
