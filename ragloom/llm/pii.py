"""Personal data: base patterns with checks, and further spans by boosted trees.

Generators with high recall propose spans of each kind in forms that the base patterns leave out
(written-out addresses, numbers without a plus, failed check digits, other address families).
Boosted trees, trained on the base patterns' own candidates (those that pass their check
against those that fail, and digits inside other words), score a proposal by its format and the
text around it; thresholds calibrated on held-out candidates decide. Everything runs in the JVM: spans
are found by SQL functions, the trees are fitted by Spark ML and applied as one SQL expression.
"""

from __future__ import annotations

import re
from functools import partial

import numpy as np
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragloom.llm.common import fresh, materialize

KINDS = ("email", "ip", "card", "phone")
# The base patterns. Possessive and looking back, so that long runs cost linear time and no stack; they match
# what the plain patterns match, because a plain match always begins where a run does or the last one ended.
_LOCAL, _DOMAIN = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_DOMAIN}++(?:\.{_DOMAIN}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
PROPOSED = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}++ ?(?:\(at\)|\[at\]|\{{at\}}| AT ) ?{_DOMAIN}++(?: ?(?:\.|\(dot\)|\[dot\]|\{{dot\}}| DOT ) ?{_DOMAIN}++)++",
    "ip": r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){4,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "card": BASE["card"],
    "phone": r"(?<![0-9A-Za-z+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])",
}
DECOY = r"(?<=[A-Za-z])[0-9]{4,}+(?=[A-Za-z])"
CONTEXT = {
    "email": r"(?i)mail|contact|write|@", "ip": r"(?i)\bip\b|host|server|address", "card": r"(?i)card|visa|credit|account|pay",
    "phone": r"(?i)phone|tel|call|fax|mobile|contact",
}
PRECISION, SCORE_PLACES = 0.95, 1_000_000
_BLOCK = 64
_SPAN = "array<struct<start:int,end:int,m:string,before:string,after:string>>"


def find(df: DataFrame, text: str, pattern: str, out: str) -> DataFrame:
    """Adds ``out``: the pattern's matches in the column ``text``, leftmost and non-overlapping, with
    start and end in code points and the 24 characters before, 8 after (up to other matches).

    The texts between the matches give the places, by sums over blocks of matches, so a text with
    very many costs no square of them."""
    ms, ps, sizes, blocks = fresh(df, "_ms", "_ps", "_sizes", "_blocks")
    df = df.withColumn(ms, F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)))
    df = df.withColumn(ps, F.when(F.size(ms) > 0, F.split(F.col(text), pattern, -1)))
    df = df.withColumn(sizes, F.transform(ms, lambda m, i: F.length(m) + F.length(F.get(F.col(ps), i))))

    def total(a, n):
        return F.aggregate(F.slice(F.col(sizes), a, n), F.lit(0), lambda acc, x: acc + x)

    sums = F.transform(F.sequence(F.lit(0), F.floor((F.size(ms) - 1) / _BLOCK).cast("int")),
                       lambda b: total(b * _BLOCK + 1, F.lit(_BLOCK)))
    df = df.withColumn(blocks, F.when(F.size(ms) > 0, F.aggregate(
        sums, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))))

    def span(m, i):
        block = F.floor(i / _BLOCK).cast("int")
        gap = F.get(F.col(ps), i)
        start = F.get(F.col(blocks), block) + total(block * _BLOCK + 1, i - block * _BLOCK) + F.length(gap)
        return F.struct(start.alias("start"), (start + F.length(m)).alias("end"), m.alias("m"),
                        F.right(gap, F.lit(24)).alias("before"), F.left(F.get(F.col(ps), i + 1), F.lit(8)).alias("after"))

    found = F.when(F.size(ms) > 0, F.transform(ms, span)).otherwise(F.array().cast(_SPAN))
    return df.withColumn(out, F.coalesce(found, F.array().cast(_SPAN))).drop(ms, ps, sizes, blocks)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    d = F.reverse(_digits(m))

    def value(i):
        x = F.substring(d, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return F.when(x > 9, x - 9).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda acc, i: acc + value(i)) % 10 == 0


def passes(kind: str, m: Column) -> Column:
    """The check of a base match."""
    if kind == "ip":
        return F.regexp_like(m, F.lit(r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])?(?:\.|$)){4}"))
    if kind == "card":
        return _luhn(m)  # the pattern has 13 to 19 digits
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def _features(kind: str, s: Column) -> list[Column]:
    """Numbers on a span's format and its neighbourhood; none of them is its check."""
    m, before, after = s["m"], s["before"], s["after"]
    flag = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    return [F.lit(float(KINDS.index(kind))), F.length(m).cast("double"), F.length(_digits(m)).cast("double"),
            F.length(F.regexp_replace(m, "[^ ().-]", "")).cast("double"), F.length(F.regexp_replace(m, "[^A-Za-z]", "")).cast("double"),
            F.size(F.split(m, "[^0-9]+")).cast("double"), flag(m.startswith("+")), flag(m.contains("@")),
            flag(F.regexp_like(before, F.lit(r"[A-Za-z0-9_]$"))), flag(F.regexp_like(after, F.lit(r"^[A-Za-z0-9_]"))),
            flag(F.regexp_like(before, F.lit(r"""[=:"']\s*$"""))), flag(F.regexp_like(before, F.lit(CONTEXT[kind])))]


# ---- the trees ------------------------------------------------------------------------------

def tree_expression(text: str, feature) -> Column:
    """A fitted regression tree, as Spark prints it, as a Column; ``feature(i)`` gives feature i."""
    lines = [x.strip() for x in text.splitlines()[1:] if x.strip()]

    def node():
        line = lines.pop(0)
        if line.startswith("Predict:"):
            return F.lit(float(line.split(":")[1]))
        i, limit = re.fullmatch(r"If \(feature (\d+) <= (\S+)\)", line).groups()
        left = node()
        lines.pop(0)  # Else
        return F.when(feature(int(i)) <= float(limit), left).otherwise(node())

    return node()


class Model:
    """Trees with weights, and for each kind the least score that is redacted (above 1: none)."""

    def __init__(self, trees: list[str], weights: list[float], least: dict[str, float]):
        self.trees, self.weights, self.least = trees, weights, least

    def score(self, x: Column) -> Column:
        """Of an array of features."""
        margin = sum((tree_expression(t, lambda i: F.get(x, F.lit(i))) * w for t, w in zip(self.trees, self.weights)), F.lit(0.0))
        return 1 / (1 + F.exp(-2 * margin))

    def accepted(self, kind: str, spans: Column) -> Column:
        """For each span of an array whether it is redacted; its features are made once."""
        xs = F.transform(spans, lambda s: F.array(*_features(kind, s)))
        return F.transform(xs, lambda x: self.score(x) >= self.least[kind])


NO_MODEL = Model([], [], {k: 2.0 for k in KINDS})


def train(docs: DataFrame, text_col: str = "text", precision: float = PRECISION) -> Model:
    """Fit and calibrate on all of the base patterns' candidates in ``docs``, those that equal in span and
    neighbourhood once, a quarter (by a hash of these) held out for the thresholds.

    A kind's threshold is the least score, at least 0.5, above which the share of passing held-out
    candidates is ``precision``; without held-out candidates of that kind nothing is added. No
    model is fitted unless there are passing and failing candidates.
    """
    # short rows only: the texts between candidates stay behind
    parts, rows = [], docs.select(F.col(text_col).alias("t"))
    for kind, pattern in [*BASE.items(), ("decoy", DECOY)]:
        rows = find(rows, "t", pattern, kind)
    def candidate(kind, of, label):
        return F.transform(kind, lambda s: F.struct(
            F.array(*_features(of, s)).alias("x"), F.xxhash64(s["m"], s["before"], s["after"]).alias("h"),
            F.lit(of).alias("kind"), label(s["m"]).cast("double").alias("label")))

    for kind in KINDS:
        parts.append(candidate(kind, kind, partial(passes, kind)))
    parts.append(candidate("decoy", "card", lambda m: F.lit(False)))
    rows = rows.select(F.explode(F.concat(*parts)).alias("c")).select("c.*")
    rows = materialize(rows.distinct().orderBy("h", "kind"))  # in one order, so that sums are too
    fit, held = rows.where(F.pmod("h", F.lit(4)) != 0), rows.where(F.pmod("h", F.lit(4)) == 0)
    if fit.select("label").distinct().count() < 2:
        return NO_MODEL
    vectors = fit.select(array_to_vector("x").alias("features"), "label")
    gbt = GBTClassifier(maxIter=20, maxDepth=3, seed=7, maxBins=32).fit(vectors)
    model = Model([t.toDebugString for t in gbt.trees], list(gbt.treeWeights), {})
    # counts by score, to six places: what reaches the driver is bounded
    scored = held.select("kind", "label", model.score(F.col("x")).alias("score"))
    scored = scored.groupBy("kind", F.floor(F.col("score") * F.lit(SCORE_PLACES)).alias("place")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("good"), F.min("score").alias("score")).toPandas()
    for kind in KINDS:
        own = scored[scored.kind == kind].sort_values("place", ascending=False)
        good = own.good.to_numpy().cumsum() / own.n.to_numpy().cumsum()
        enough = np.flatnonzero(good >= precision)
        model.least[kind] = max(0.5, float(own.score.iloc[enough[-1]])) if len(enough) else 2.0
    return model


def spans(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Adds for each kind the base spans (email, ip, card, phone) and those that the model adds
    (more_email, ...), under names that are still free, in this order: arrays by start of start, end,
    m (the text), before, after. Row-local. Null and empty texts have none; a base span always
    stays, and an added one overlaps neither base spans nor other added ones (the leftmost stays)."""
    base = dict(zip(KINDS, fresh(docs, *KINDS)))
    more = dict(zip(KINDS, fresh(docs, *(f"more_{k}" for k in KINDS))))
    all_, taken = fresh(docs, "_all", "_taken")
    rows = docs
    for kind in KINDS:
        rows = find(rows, text_col, BASE[kind], base[kind])
        if model.least[kind] <= 1:
            rows = rows if kind == "card" else find(rows, text_col, PROPOSED[kind], more[kind])
            if kind == "card":  # proposals are the candidates whose check failed
                rows = rows.withColumn(more[kind], F.filter(base[kind], lambda s: ~passes("card", s["m"])))
            rows = rows.withColumn(taken, F.when(F.size(more[kind]) > 0, model.accepted(kind, F.col(more[kind]))))
            rows = rows.withColumn(more[kind], F.filter(more[kind], _marked(F.col(taken)))).drop(taken)
        else:
            rows = rows.withColumn(more[kind], F.array().cast(_SPAN))
        rows = rows.withColumn(base[kind], F.filter(base[kind], _passing(kind)))

    def tagged(col, kind, added):
        return F.transform(col, lambda s: F.struct(s["start"].alias("start"), F.lit(added).alias("added"),
                                                   F.lit(kind).alias("kind"), s["end"].alias("end")))

    state = "struct<base:int,own:int,kept:array<struct<start:int,kind:int>>>"

    def step(acc, s):
        over = F.when(s["start"] < acc["own"], F.slice(acc["kept"], F.lit(1), F.greatest(F.size(acc["kept"]) - 1, F.lit(0)))).otherwise(acc["kept"])
        of_base = F.struct(F.greatest(acc["base"], s["end"]).alias("base"),
                           F.when(s["start"] < acc["own"], 0).otherwise(acc["own"]).alias("own"), over.alias("kept"))
        free = s["start"] >= F.greatest(acc["base"], acc["own"])
        one = F.array(F.struct(s["start"].alias("start"), s["kind"].alias("kind")))
        of_added = F.when(free, F.struct(acc["base"].alias("base"), s["end"].alias("own"), F.concat(acc["kept"], one).alias("kept"))).otherwise(acc)
        return F.when(s["added"] == 0, of_base).otherwise(of_added).cast(state)

    both = F.array_sort(F.concat(*[tagged(c[k], i, a) for a, c in enumerate((base, more)) for i, k in enumerate(KINDS)]))
    first = F.struct(F.lit(0).alias("base"), F.lit(0).alias("own"), F.array().cast("array<struct<start:int,kind:int>>").alias("kept")).cast(state)
    proposed = sum((F.size(more[k]) for k in KINDS), F.lit(0))
    rows = rows.withColumn(all_, F.when(proposed > 0, F.aggregate(both, first, step)["kept"]))
    def kept(i):
        return lambda s: F.array_contains(F.col(all_), F.struct(s["start"].alias("start"), F.lit(i).alias("kind")))

    for i, k in enumerate(KINDS):
        rows = rows.withColumn(more[k], F.when(F.size(more[k]) > 0, F.filter(more[k], kept(i))).otherwise(F.col(more[k])))
    return rows.select(*docs.columns, *base.values(), *more.values())


def _check(kind: str):
    return lambda m: passes(kind, m)


def _passing(kind: str):
    return lambda s: passes(kind, s["m"])


def _marked(flags: Column):
    return lambda s, i: F.get(flags, i)


def redact(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, with every span in ``text_col`` replaced by its kind in
    brackets. Kind by kind the text is divided at its candidates and joined again, so the cost is
    linear; a span inside one of an earlier kind goes with it. Null texts stay null."""
    rows = docs
    ms, ps, taken = fresh(docs, "_ms", "_ps", "_taken")
    for kind in KINDS:
        ways = [BASE[kind]] + ([PROPOSED[kind]] if model.least[kind] <= 1 else [])
        for nth, pattern in enumerate(ways):
            cut = rows.withColumn(ms, F.regexp_extract_all(F.col(text_col), F.lit(pattern), F.lit(0)))
            cut = cut.withColumn(ps, F.when(F.size(ms) > 0, F.split(F.col(text_col), pattern, -1)))
            if nth == 0:
                flags = F.transform(ms, _check(kind))
            else:
                flags = model.accepted(kind, F.transform(ms, _around(F.col(ps))))
            cut = cut.withColumn(taken, F.when(F.size(ms) > 0, flags))
            joined = F.array_join(F.transform(ps, _piece(F.col(ms), F.col(taken), f"[{kind.upper()}]")), "")
            rows = cut.withColumn(text_col, F.when(F.size(ms) > 0, joined).otherwise(F.col(text_col))).drop(ms, ps, taken)
    return rows.select(*docs.columns)


def _around(ps: Column):
    """A match with its neighbourhood."""
    return lambda m, i: F.struct(m.alias("m"), F.right(F.get(ps, i), F.lit(24)).alias("before"),
                                 F.left(F.get(ps, i + 1), F.lit(8)).alias("after"))


def _piece(ms: Column, taken: Column, mark: str):
    """A text between matches and the match after it, or its mark."""
    return lambda p, i: F.concat(p, F.when(F.get(taken, i), mark).otherwise(F.coalesce(F.get(ms, i), F.lit(""))))
