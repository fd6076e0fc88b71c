"""Secret scans: long opaque strings, sorted out by a random forest.

Every run of at least 16 characters of keys and tokens is a finding; most are long words. The forest
judges them by length, character transitions (changes of class, and how usual the pairs of letters
are in the corpus), coverage by four-letter pieces of the corpus' frequent words, the path, and the
neighbouring words. It is trained on labelled findings. Everything runs in the JVM: findings and
features are SQL functions on rows, Spark ML fits the trees, and they are applied as one SQL expression.
"""

from __future__ import annotations

import math

from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragloom.llm.common import fresh, materialize
from ragloom.llm.pii import find, tree_expression
from ragloom.operators.metrics import attach_scalars

FINDING = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}+"
ASSIGNED = r"""(?i)(?:key|token|secret|passw|pwd|auth|cred)[A-Za-z_]*["']?\s*[:=]\s*["']?$"""
NAMED = r"(?i)key|token|secret|passw|pwd|auth|cred|bearer"
HARMLESS = r"(?i)example|sample|dummy|test|placeholder|sha1|commit|hash"
TEST_PATH = r"(?i)test|example|sample|doc|readme"
WORDS, LETTERS, GRAM_BITS = 5_000, 26, 18
MAX_LABELLED = 10_000  # different ones of each label
PIECE = 256  # positions of a finding that are read from one piece of it
TREES, DEPTH = 15, 5


def _gram_place(gram: Column) -> Column:
    return F.xxhash64(gram).bitwiseAND((1 << GRAM_BITS) - 1)


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """What the features need of the corpus, in one row of fixed size: pairs, the log probability of each
    pair of letters, and grams, a bit string of the hashes of the frequent words' four-letter pieces.
    Counts over all words of at least four letters in all texts; the counts are pre-aggregated before
    their exchange. The driver gets 676 pairs, ``WORDS`` words' pieces as 2 ** (GRAM_BITS - 6) numbers."""
    words = docs.select(F.explode(F.split(F.lower(F.col(text_col)), "[^a-z]+")).alias("w")).where(F.length("w") >= 4)
    counts = materialize(words.groupBy("w").agg(F.count(F.lit(1)).alias("n")))
    cut = lambda w, size: F.transform(F.sequence(F.lit(1), F.length(w) - (size - 1)), lambda i: F.substring(F.col(w), i, F.lit(size)))
    seen = {r.p: r.n for r in counts.select(F.explode(cut("w", 2)).alias("p"), "n").groupBy("p").agg(F.sum("n").alias("n")).collect()}
    total = sum(seen.values())
    letters = [chr(97 + i) for i in range(LETTERS)]
    pairs = [math.log((seen.get(a + b, 0) + 0.5) / (total + 0.5 * LETTERS ** 2)) for a in letters for b in letters]
    frequent = counts.orderBy(F.desc("n"), "w").limit(WORDS)
    places = frequent.select(F.explode(cut("w", 4)).alias("g")).select(_gram_place(F.col("g")).alias("p")).distinct()
    held = places.groupBy(F.shiftright("p", 6).alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(p & 63 AS INT))")).alias("b")).collect()
    grams = [0] * (1 << (GRAM_BITS - 6))
    for r in held:
        grams[r.i] = r.b
    return docs.sparkSession.createDataFrame([(pairs, grams)], "pairs array<double>, grams array<bigint>")


def _features() -> list[Column]:
    """Of a finding (columns m, before, after, path) and the corpus (pairs, grams)."""
    m, before, after, path = (F.col(c) for c in ("m", "before", "after", "path"))
    n = F.length(m).cast("double")
    low = F.lower(m)
    flag = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    without = lambda p: (n - F.length(F.regexp_replace(m, p, ""))) / n

    def usual(piece, i):
        a, b = F.ascii(F.substring(piece, i, F.lit(1))) - 97, F.ascii(F.substring(piece, i + 1, F.lit(1))) - 97
        known = F.get(F.col("pairs"), a * LETTERS + b)
        return F.when((a >= 0) & (a < LETTERS) & (b >= 0) & (b < LETTERS), known).otherwise(-12.0)

    def covered(piece, i):
        p = _gram_place(F.substring(piece, i, F.lit(4)))
        bit = F.getbit(F.get(F.col("grams"), F.shiftrightunsigned(p, 6).cast("int")), p.bitwiseAND(63).cast("int"))
        return bit.cast("double")

    def mean(f, last):
        """Over all positions but the ``last`` ones, by pieces: to find a place in a string takes its distance."""
        starts = F.sequence(F.lit(0), F.floor((F.length(m) - last - 1) / PIECE).cast("int"))
        pieces = F.transform(starts, lambda j: F.substring(low, j * PIECE + 1, F.lit(PIECE + last)))
        return F.aggregate(pieces, F.lit(0.0), lambda acc, piece: F.aggregate(
            F.sequence(F.lit(1), F.length(piece) - last), acc, lambda total, i: total + f(piece, i))) / (n - last)

    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(m, "[a-z]+", "a"), "[A-Z]+", "b"), "[0-9]+", "c")
    return [n, F.length(classes) / n, mean(usual, 1), mean(covered, 3), without("[0-9]"), without("[A-Z]"), without("[+/_=-]"),
            flag(F.regexp_like(m, F.lit("^[0-9a-fA-F]+$"))), flag(F.regexp_like(before, F.lit(ASSIGNED))),
            flag(F.regexp_like(before, F.lit(NAMED))), flag(F.regexp_like(before, F.lit(HARMLESS))),
            flag(F.regexp_like(after, F.lit("""^["']"""))), flag(F.regexp_like(path, F.lit(TEST_PATH)))]


def findings(docs: DataFrame, stats: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             path_col: str | None = "source") -> DataFrame:
    """One row per finding: doc_id, start, end (code points), m, before, after, x (features). The
    texts stay behind before the one row of statistics, of fixed size, is broadcast to the findings."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"),
                       (F.col(path_col) if path_col else F.lit("")).cast("string").alias("path"))
    # a filter before the generator, or one that Spark infers from it, would copy the search into each use
    rows = find(rows, "t", FINDING, "found").select("doc_id", "path", F.inline_outer("found")).where("start is not null")
    rows = attach_scalars(rows, stats)
    return rows.select("doc_id", "start", "end", "m", "before", "after", F.array(*_features()).alias("x"))


def label_by_rule(found: DataFrame) -> DataFrame:
    """Labels for findings (columns m, before) where nobody has labelled any: 1 for a value with digits
    and letters assigned to a name of secrets, 0 for runs of letters that nothing near names; others
    null, and left out of training."""
    named, assigned = F.regexp_like("before", F.lit(NAMED)), F.regexp_like("before", F.lit(ASSIGNED))
    mixed = F.regexp_like("m", F.lit("[0-9]")) & F.regexp_like("m", F.lit("[A-Za-z]"))
    harmless = F.regexp_like("before", F.lit(HARMLESS))
    return found.withColumn("label", F.when(assigned & mixed & ~harmless, 1.0).when(harmless | ~named & ~mixed, 0.0))


def sample(labelled: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """Findings with x and label (0 or 1; others are ignored), equal ones as one row with their number w:
    at most ``max_labelled`` different ones of each label, by the order of a hash of the features."""
    rows = labelled.where("label in (0, 1)").groupBy("x", F.col("label").cast("double").alias("label")).agg(
        F.count(F.lit(1)).cast("double").alias("w")).withColumn("h", F.xxhash64("x"))
    parts = [rows.where(F.col("label") == y).orderBy("h").limit(max_labelled) for y in (0.0, 1.0)]
    return materialize(parts[0].unionByName(parts[1]))


def train(labelled: DataFrame, max_labelled: int = MAX_LABELLED) -> list[str]:
    """The forest's trees, from a ``sample`` of findings, weighted by the number of equal ones. Empty unless
    both labels occur."""
    rows = sample(labelled, max_labelled)
    if rows.select("label").distinct().count() < 2:
        return []
    forest = RandomForestRegressor(numTrees=TREES, maxDepth=DEPTH, seed=11, featureSubsetStrategy="onethird", weightCol="w")
    return [t.toDebugString for t in forest.fit(rows.select(array_to_vector("x").alias("features"), "label", "w")).trees]


def score(x: Column, trees: list[str]) -> Column:
    """The forest's mean for an array of features, 0 to 1; 0 without trees."""
    if not trees:
        return F.lit(0.0)
    return sum((tree_expression(t, lambda i: F.get(x, F.lit(i))) for t in trees), F.lit(0.0)) / len(trees)


def scan(docs: DataFrame, label=label_by_rule, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source",
         least: float = 0.5) -> DataFrame:
    """One row per finding in ``docs``: doc_id, start, end (code points), secret_text, score and secret
    (score at least ``least``). ``label`` adds the column label to findings, from wherever labelled
    findings come. Null and empty texts have no findings; repeated rows give repeated ones; other
    columns are ignored. Without labels of both kinds every score is 0."""
    found = materialize(findings(docs, statistics(docs, text_col), id_col, text_col, path_col))
    trees = train(label(found))
    return found.select("doc_id", "start", "end", F.col("m").alias("secret_text"), score(F.col("x"), trees).alias("score")).withColumn(
        "secret", F.col("score") >= least)


def redact(docs: DataFrame, secrets: DataFrame, mark: str = "[SECRET]", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose texts have every secret of their id (as ``scan`` gives
    them) replaced by ``mark``. The list of a document's secrets is grouped, bounded by its text."""
    key, found, pattern = fresh(docs, "_key", "_found", "_pattern")
    own = secrets.where("secret").groupBy(F.col("doc_id").alias(key)).agg(F.collect_set("secret_text").alias(found))
    rows = docs.join(own, F.col(id_col).cast("long").eqNullSafe(F.col(key)), "left")
    quoted = F.transform(F.sort_array(found, asc=False), lambda s: F.concat(F.lit("\\Q"), s, F.lit("\\E")))
    rows = rows.withColumn(pattern, F.concat(F.lit("(?<![A-Za-z0-9+/_=-])(?:"), F.array_join(quoted, "|"), F.lit(")(?![A-Za-z0-9+/_=-])")))
    text = F.when(F.size(found) > 0, F.regexp_replace(F.col(text_col), F.col(pattern), F.lit(mark))).otherwise(F.col(text_col))
    return rows.withColumn(text_col, text).select(*docs.columns)
