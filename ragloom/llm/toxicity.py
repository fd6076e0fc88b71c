"""Toxicity by non-negative positive-unlabelled learning.

Known are documents confirmed as toxic, and text without labels of which an unknown part is
toxic. With the class prior p, the share of toxic documents, the risk of a scorer g is
``p * R+(positive) + max(0, R-(unlabelled) - p * R-(positive))``: the unlabelled text counts as
negative, corrected by what its toxic part adds. Where the corrected part of a batch gets
negative (the scorer learns the confirmed examples by heart) its gradient is reversed.
The scorers are linear in hashed words and word beginnings that are clearly more frequent in the
confirmed examples, trained with numpy; several, with different orders of the rows, are averaged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom.llm.common import fresh

BITS = 18
MAX_POSITIVE, MAX_UNLABELLED = 4_000, 12_000
EPOCHS, BATCH, RATE, DECAY, SCORERS = 20, 1024, 0.02, 1e-3, 3
LEAST_SHARE = 0.005  # of the confirmed examples that have a feature of interest
# its share there over that in unlabelled text is at most 1 / prior, for a feature of toxic text alone; this much of the excess over 1
LEAST_EXCESS = 0.25
MAX_WORDS = 60_000  # words whose features a task keeps
_WORD = re.compile(r"\w+")
_MASK = (1 << BITS) - 1


class _Places(dict):
    """The feature numbers of a word: itself and its first four and five characters. A task has its own, of
    bounded size, so that nothing stays in a worker after it."""

    def __missing__(self, word: str) -> tuple:
        if len(self) > MAX_WORDS:
            self.clear()
        parts = [word, *("^" + word[:n] for n in (4, 5) if len(word) >= n)]
        found = tuple(xxhash.xxh32_intdigest(p) & _MASK for p in parts)
        if len(word) <= 64:
            self[word] = found
        return found


def features(text: str | None, places: _Places) -> np.ndarray:
    """The distinct feature numbers of a whole text; none for null or empty."""
    found = set(_WORD.findall((text or "").lower()))
    return np.unique(np.fromiter((i for w in found for i in places[w]), np.int32))


class Model:
    """Weights of the features of interest and biases of the scorers."""

    def __init__(self, weights: dict[int, np.ndarray], bias: np.ndarray):
        self.weights, self.bias = weights, bias

    def scorer(self):
        """A function from a whole text to the scorers' mean, 0 to 1; words without a feature of interest, and
        so null and empty texts, leave the biases alone. 0 if nothing was learned."""
        weights, bias, places = self.weights, self.bias, _Places()
        known: dict[str, tuple] = {}

        def score(text: str | None) -> float:
            if not len(bias):
                return 0.0
            if len(known) > MAX_WORDS:
                known.clear()
            there: set = set()
            for w in set(_WORD.findall((text or "").lower())):
                if (found := known.get(w)) is None:
                    found = tuple(i for i in places[w] if i in weights)
                    if len(w) <= 64:
                        known[w] = found
                if found:
                    there.update(found)
            z = bias.copy()
            for i in sorted(there):
                z += weights[i]
            return float((1 / (1 + np.exp(-np.clip(z, -50, 50)))).mean())

        return score


def risk_slopes(z: np.ndarray, is_pos: np.ndarray, prior: float) -> np.ndarray:
    """The slope of the risk at each row's score ``z``; that of the corrected part reversed where it is negative."""
    n_pos, n_unl = int(is_pos.sum()), int((~is_pos).sum())
    s = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
    # logistic losses; their slopes: as positive s - 1, as negative s
    loss = np.logaddexp(0, z)
    negative = loss[~is_pos].mean() - prior * loss[is_pos].mean()
    to_negative = np.where(is_pos, -prior / n_pos, 1 / max(1, n_unl)) * s
    if negative >= 0:
        return np.where(is_pos, prior / n_pos, 0) * (s - 1) + to_negative
    return -to_negative


def _fit_one(rows: list[np.ndarray], positive: np.ndarray, n_features: int, prior: float, seed: int):
    """Weights and bias of one scorer by Adam on the non-negative risk."""
    rng = np.random.default_rng(seed)
    w, b = np.zeros(n_features), 0.0
    m, v, mb, vb, step = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0, 0
    pos, unl = np.flatnonzero(positive), np.flatnonzero(~positive)
    n_batches = max(1, -(-len(unl) // BATCH))
    for _ in range(EPOCHS):
        # every batch has both kinds
        for pb, ub in zip(np.array_split(rng.permutation(np.resize(pos, max(len(pos), n_batches))), n_batches),
                          np.array_split(rng.permutation(unl), n_batches)):
            batch = np.concatenate([pb, ub])
            is_pos = np.arange(len(batch)) < len(pb)
            sizes = np.array([len(rows[i]) for i in batch])
            at = np.concatenate([rows[i] for i in batch]) if sizes.sum() else np.zeros(0, np.int32)
            owner = np.repeat(np.arange(len(batch)), sizes)
            z = np.bincount(owner, w[at], len(batch)) + b
            g = risk_slopes(z, is_pos, prior)
            step += 1
            gw = np.bincount(at, np.repeat(g, sizes), n_features) + DECAY * w
            gb = g.sum()
            m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
            mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
            a, c = 1 - 0.9 ** step, 1 - 0.999 ** step
            rate = RATE * (1 - step / (EPOCHS * n_batches + 1))  # falls to zero
            w -= rate * (m / a) / (np.sqrt(v / c) + 1e-8)
            b -= rate * (mb / a) / (np.sqrt(vb / c) + 1e-8)
    return w, b


def fit(rows: list[np.ndarray], positive: np.ndarray, prior: float) -> Model:
    """Train on the feature numbers of confirmed examples (``positive``) and unlabelled texts."""
    n_pos, n_unl = int(positive.sum()), int((~positive).sum())
    if not n_pos or not n_unl:
        return Model({}, np.zeros(0))
    count = lambda which: np.bincount(np.concatenate([rows[i] for i in np.flatnonzero(which)]), minlength=1 << BITS)
    in_pos, in_unl = count(positive), count(~positive)
    lift = ((in_pos + 1) / (n_pos + 2)) / ((in_unl + 1) / (n_unl + 2))
    of_interest = np.flatnonzero((in_pos >= max(3, LEAST_SHARE * n_pos)) & (lift >= 1 + LEAST_EXCESS * (1 / prior - 1)))
    if not len(of_interest):  # nothing tells the kinds apart
        return Model({}, np.zeros(0))
    place = np.full(1 << BITS, -1)
    place[of_interest] = np.arange(len(of_interest))
    rows = [p[p >= 0] for p in (place[r] for r in rows)]
    found = [_fit_one(rows, positive, max(1, len(of_interest)), prior, seed) for seed in range(SCORERS)]
    weights = np.array([w for w, _ in found]).T
    return Model({int(i): weights[k] for k, i in enumerate(of_interest)}, np.array([b for _, b in found]))


# ---- Spark ---------------------------------------------------------------------------------

def held_out(id_col: str):
    """True where crc32 of the id as text leaves no remainder by 5; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _feature_rows(batches):
    places = _Places()
    for batch in batches:
        found = [features(t, places) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], ["positive", "found"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> Model:
    """A model from the rows that are not held out.

    At most ``max_positive`` documents labelled 1 and ``max_unlabelled`` others of whatever
    label, by the order of their ids' hash, go to the trainer; their labels 0 are not used but for
    the class prior, which is counted over all labels not held out. Several labels of a
    document count as 1 if one is. Of an id that several rows have, one text is used, that of
    the least hash (null: empty), so the driver gets no more rows than the two bounds. Null ids and
    labels are ignored.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(
        F.col(id_col).alias("id")).agg(F.max(label_col).alias("y"))
    prior = known.agg(F.avg((F.col("y") == 1).cast("double"))).first()[0]
    if not prior:
        return Model({}, np.zeros(0))
    order = (F.xxhash64("id"), F.col("id"))
    pos = known.where("y = 1").orderBy(*order).limit(max_positive).select("id", F.lit(True).alias("positive"))
    ids = docs.where(F.col(id_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("id")).distinct()
    unl = ids.orderBy(*order).limit(max_unlabelled).select("id", F.lit(False).alias("positive"))
    chosen = F.broadcast(pos.unionByName(unl))  # at most max_positive + max_unlabelled rows
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(chosen, "id")
    rows = rows.groupBy("id", "positive").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    rows = rows.select("positive", "text").mapInArrow(
        _feature_rows, "positive boolean, found array<int>").toArrow()
    found = [np.asarray(r.as_py(), np.int32) for r in rows.column("found")]
    return fit(found, np.array(rows.column("positive").to_pylist(), bool), float(prior))


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """Adds the score of every whole text to the rows, repeated rows alike; no exchange. Null and
    empty texts, and all texts if nothing was learned: see ``Model.scorer``."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # at most 2 ** BITS weights of each scorer

    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of = held.value.scorer()
        for texts in batches:
            yield pa.array([of(t) for t in texts.to_pylist()], pa.float64())

    return docs.withColumn(out, F.arrow_udf(scored, "double")(F.col(text_col)))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5,
               **options) -> DataFrame:
    """The rows of ``docs``, all columns, that a model trained on them scores below ``least``. All rows stay
    if nothing was learned: no labels, one kind only, or no feature that tells the kinds apart. Null
    and empty texts have the biases' score; repeated rows stay or go together."""
    (name,) = fresh(docs, "_score")
    model = train(docs, labels, id_col, text_col, **options)
    return score(docs, model, text_col, name).where(F.col(name) < least).drop(name)
