"""SimHash near-duplicates by covering locality-sensitive hashing.

Each of the 64 bits gets one of the 2^(r+1) - 1 nonzero vectors of r + 1 bits, evenly; the
table of vector v masks the bits whose vectors have an odd inner product with v. At most r
differing bits span a space of dimension r at most, so some v is orthogonal to them all:
its mask leaves those bits out, and the two fingerprints collide in that table. No pair within
the radius is missed, whatever the fingerprints.

Buckets can hold any number of fingerprints, so their pairs are never listed. Members of a
bucket differ in unmasked bits only; each gives all fingerprints up to half of r (rounded up)
unmasked flips away as keys, so two members within r bits share one. A key links its
members, of which there is a bounded number as they are distinct, to one of them that is
within half of r (rounded down) of it, hence within r bits of them all.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom.llm.common import fresh, materialize, text_bytes

BITS, SEED = 64, 42


def fingerprint(text: bytes | None, shingle: int) -> int:
    """A text's fingerprint: of the XXH64 of its shingles, repeats included, each bit set in
    over half of them. Words are runs without ASCII white space, A-Z lower-cased."""
    w = text.lower().split() if text else []  # of bytes: ASCII letters and white space only
    if not w:
        return 0
    xxh = xxhash.xxh64_intdigest
    if len(w) <= shingle:
        grams = [b" ".join(w)]
    else:
        grams = map(b" ".join, zip(*(w[i:] for i in range(shingle))))
    h = np.fromiter((xxh(g, SEED) for g in grams), np.uint64)
    ones = np.zeros(BITS, np.int64)
    for a in range(0, len(h), 1 << 16):
        part = np.ascontiguousarray(h[a:a + (1 << 16)]).astype(">u8").view(np.uint8)
        ones += np.unpackbits(part).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h)).tobytes(), "big")


def _fingerprint_rows(shingle: int):
    def rows(batches):
        for batch in batches:
            found = np.fromiter((fingerprint(t, shingle) for t in text_bytes(batch.column(1))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return rows


def _fingerprint_column(shingle: int):
    def made(texts: pa.Array) -> pa.Array:
        return pa.array([_signed(fingerprint(t, shingle)) for t in text_bytes(texts)], pa.int64())

    return made


def fingerprints(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, of every row; no exchange."""
    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(_fingerprint_rows(shingle), "doc_id long, fp long")


def covering_masks(radius: int) -> list[int]:
    """The 2^(radius+1) - 1 masks, as unsigned integers."""
    n = (1 << (radius + 1)) - 1
    vector = [1 + i % n for i in range(BITS)]
    return [sum(1 << i for i, m in enumerate(vector) if (m & v).bit_count() % 2) for v in range(1, n + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(distinct: DataFrame, radius: int) -> DataFrame:
    """Edges (a, b) between the fingerprints of ``distinct`` (column fp, no repeats), whose
    components are those of all pairs within ``radius`` bits.

    Tables shuffle (table, masked value, fp); only members of buckets with several go on.
    """
    masks = covering_masks(radius)
    tables = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("m"))
                                 for t, m in enumerate(masks)]))
    dealt = distinct.select("fp", tables.alias("k")).select("fp", "k.t", "k.m")
    shared = dealt.groupBy("t", "m").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    members = dealt.join(shared, ["t", "m"])
    reach = (radius + 1) // 2
    flips = [[(k, _signed(sum(1 << b for b in bits))) for k in range(reach + 1)
              for bits in itertools.combinations([i for i in range(BITS) if not m >> i & 1], k)] for m in masks]
    per_table = [F.array(*[F.struct(F.lit(k).alias("far"), F.lit(f).alias("flip")) for k, f in t]) for t in flips]
    keys = members.select("fp", "t", F.explode(F.element_at(F.array(*per_table), F.col("t") + 1)).alias("f")).select(
        "fp", "t", F.col("f.far").alias("far"), F.col("f.flip").bitwiseXOR(F.col("fp")).alias("key"))
    # all members of a key are within ``radius`` of each that is within half of it (rounded down) of the key
    met = keys.groupBy("t", "key").agg(F.collect_list("fp").alias("met"), F.min(
        F.when(F.col("far") <= radius // 2, F.col("fp"))).alias("b")).where(F.size("met") > 1)
    return met.select(F.explode("met").alias("a"), "b").where("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): each node of the edges (a, b) with the least node that it is linked to.

    Alternates two steps on a written edge table until it stops changing: each node's larger
    neighbours are linked to its least one, then its smaller ones. The number of edges never
    grows, and the distance to the root shrinks geometrically. The least neighbour is a
    pre-aggregated minimum, joined back; a node with very many neighbours is a skewed join key,
    which AQE splits.
    """
    def state(e):
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    now = state(edges)
    while now[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("x"), "a", "m")
        small = small.select(F.explode(F.array(F.struct("x", "m"), F.struct(F.col("a").alias("x"), "m"))).alias("e"))
        small = small.select(F.col("e.x").alias("a"), F.col("e.m").alias("b")).where("a > b").distinct()
        edges = materialize(small)
        before, now = now, state(edges)
        if now == before:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, fp (signed long), root (the least fingerprint its own is linked
    to, by any number of links of at most ``radius`` differing bits) and component_id (the
    smallest id in that component; null if all are null).

    Fingerprints are written once, with 16 bytes a row; copies collapse to one fingerprint
    before any search. Null and empty texts have fingerprint zero, linked like any other. Rows
    are not merged: repeated rows come out as often as they came. Other columns are ignored.
    """
    rows = materialize(fingerprints(docs, shingle, id_col, text_col))
    smallest = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    found = components(links(smallest.select("fp"), radius))
    classes = smallest.join(found, F.col("fp") == F.col("node"), "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    ids = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(classes.drop("first").join(ids, "root"), "fp").select("doc_id", "fp", "root", "component_id")


def deduplicate(docs: DataFrame, shingle: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, of one document for each component: that with the smallest
    id (nulls last), of several rows with that id one with the smallest fingerprint.

    The kept (id, fingerprint) pairs are found on narrow rows. The texts are exchanged once, by
    id; fingerprints are made again only where an id occurs in several rows.
    """
    near = near_duplicates(docs, shingle, radius, id_col, text_col)
    best = near.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp")).alias("k"))
    many = near.groupBy("doc_id").agg((F.count(F.lit(1)) > 1).alias("many"))
    key, none, fp, several, own = fresh(docs, "_key", "_none", "_fp", "_several", "_own")
    many = many.where("many").select(F.col("doc_id").alias("id"), F.lit(True).alias("many"))
    keep = best.select("k.none", "k.doc_id", "k.fp").join(many, F.col("doc_id").eqNullSafe(F.col("id")), "left").select(
        F.coalesce("doc_id", F.lit(0)).alias(key), F.col("none").alias(none), F.col("fp").alias(fp),
        F.coalesce("many", F.lit(False)).alias(several))
    keep = materialize(keep)
    id_ = F.col(id_col).cast("long")
    rows = docs.withColumns({key: F.coalesce(id_, F.lit(0)), none: id_.isNull()}).join(keep, [key, none])
    single = rows.where(~F.col(several)).select(*docs.columns)
    if keep.where(several).isEmpty():
        return single
    made = F.arrow_udf(_fingerprint_column(shingle), "long")
    repeated = rows.where(several).withColumn(own, made(F.col(text_col))).where(F.col(own) == F.col(fp))
    return single.unionByName(repeated.dropDuplicates([key, none, fp]).select(*docs.columns))
