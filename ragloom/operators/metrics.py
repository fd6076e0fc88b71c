"""Evaluation (L): BLEU, ROUGE-N/L, greedy embedding match, Recall@K, MRR, report.

Pairs tables have ``qid, reference, prediction``. N-gram metrics explode n-grams
per pair and aggregate (partial aggregation, no pair-of-pairs work); corpus BLEU is
one global aggregate. ROUGE-L and the greedy match need a per-pair fold (bit-parallel)
or similarity matrix, so they run per row in Arrow batches, bounded by
the lengths of the two texts.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as TY

from ragloom import constants as C
from ragloom.functions import text as T
from ragloom.operators import sizing

# ------------------------------------------------------------------ tokenizers
# BLEU: the "13a" rules (HTML entities, punctuation split off, period/comma split
# unless next to a digit, dash split after a digit), case kept, whitespace split.
_BLEU_RULES = (
    (r"([{-~\[-`\x20-&(-+:-@/])", " {1} "),
    (r"([^0-9])([.,])", "{1} {2} "),
    (r"([.,])([^0-9])", " {1} {2}"),
    (r"([0-9])(-)", "{1} {2} "),
)
_ENTITIES = (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"))


def _ws_split(c: Column) -> Column:
    return F.filter(F.split(T.squash_ws(c), " "), lambda t: t != F.lit(""))


def bleu_tokens(c) -> Column:
    s = F.col(c) if isinstance(c, str) else c
    s = F.replace(F.replace(F.replace(s, F.lit("<skipped>"), F.lit("")), F.lit("-\n"), F.lit("")), F.lit("\n"), F.lit(" "))
    for a, b in _ENTITIES:
        s = F.replace(s, F.lit(a), F.lit(b))
    s = F.concat(F.lit(" "), s, F.lit(" "))
    for pat, rep in _BLEU_RULES:
        s = F.regexp_replace(s, pat, rep.replace("{1}", "$1").replace("{2}", "$2"))
    return _ws_split(s)


def bleu_tokens_sql(e: str) -> str:
    s = f"replace(replace(replace({e}, '<skipped>', ''), '-' || chr(10), ''), chr(10), ' ')"
    for a, b in _ENTITIES:
        s = f"replace({s}, '{a}', '{b}')"
    s = f"(' ' || {s} || ' ')"
    for pat, rep in _BLEU_RULES:
        s = f"regexp_replace({s}, '{pat}', '{rep.replace('{1}', chr(92) + '1').replace('{2}', chr(92) + '2')}', 'g')"
    return ws_split_sql(s)


def ws_split_sql(e: str) -> str:
    return f"list_filter(string_split({T.squash_ws_sql(e)}, ' '), lambda t: t <> '')"


def rouge_tokens(c) -> Column:
    """Lower case, every run of characters outside ``a-z0-9`` is a separator."""
    s = F.col(c) if isinstance(c, str) else c
    return F.filter(F.split(F.lower(s), "[^a-z0-9]+"), lambda t: t != F.lit(""))


def rouge_tokens_sql(e: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({e}), '[^a-z0-9]+'), lambda t: t <> '')"


def ngrams(tokens: Column, n: int) -> Column:
    """The n-grams of a token array, each as its tokens joined by one space."""
    return F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1),
                       lambda i: F.array_join(F.slice(tokens, i, n), " ")) if n > 0 else tokens


def _tagger(n: int, side: int):
    return lambda g: F.struct(F.lit(n).alias("n"), F.lit(side).alias("side"), g.alias("gram"))


def _overlap(pairs: DataFrame, tok_fn, orders) -> DataFrame:
    """Per (qid, n): clipped matches, prediction n-grams, reference n-grams, token counts.

    Both sides are tokenised once; one generator emits every n-gram of every order
    tagged with its side (plus one marker row per order, so pairs without n-grams of
    some order still get a row); clipping is ``least`` of the two side counts after one
    aggregation, so no join is needed.
    """
    t = pairs.select("qid", tok_fn(F.col("prediction")).alias("tp"), tok_fn(F.col("reference")).alias("tr"))
    items = []
    for n in orders:
        items.append(F.array(F.struct(F.lit(n).alias("n"), F.lit(2).alias("side"), F.lit(None).cast("string").alias("gram"))))
        for side, col in ((0, "tp"), (1, "tr")):
            grams = F.when(F.size(col) >= n, ngrams(F.col(col), n)).otherwise(F.array().cast("array<string>"))
            items.append(F.transform(grams, _tagger(n, side)))
    # marker rows keep the list from being empty; for explode, Spark adds a filter that makes the n-grams once more
    e = t.select("qid", F.explode_outer(F.concat(*items)).alias("x")).select("qid", "x.n", "x.side", "x.gram")
    per_gram = e.groupBy("qid", "n", "gram").agg(
        F.sum((F.col("side") == 0).cast("long")).alias("cp"), F.sum((F.col("side") == 1).cast("long")).alias("cr"))
    per_n = per_gram.groupBy("qid", "n").agg(
        F.sum(F.least("cp", "cr")).alias("match"), F.sum("cp").alias("pred_n"), F.sum("cr").alias("ref_n"))
    return per_n.select("qid", "n", F.col("match").cast("long").alias("match"), "pred_n", "ref_n",
                        F.col("pred_n").alias("lp"), F.col("ref_n").alias("lr"))


def bleu(pairs: DataFrame, max_order: int = 4) -> DataFrame:
    """L1: corpus BLEU (clipped n-gram precision up to ``max_order``, geometric mean,
    brevity penalty), one row: bleu, p1..p4, bp, pred_len, ref_len."""
    ov = _overlap(pairs, bleu_tokens, range(1, max_order + 1))
    sums = []
    for i in range(1, max_order + 1):
        sums += [F.sum(F.when(F.col("n") == i, F.col("match"))).alias(f"m{i}"),
                 F.sum(F.when(F.col("n") == i, F.col("pred_n"))).alias(f"poss{i}")]
    agg = ov.agg(*sums, F.sum(F.when(F.col("n") == 1, F.col("lp"))).alias("pred_len"),
                 F.sum(F.when(F.col("n") == 1, F.col("lr"))).alias("ref_len"))
    j = agg.select("*", *[F.when(F.col(f"poss{i}") > 0, F.col(f"m{i}") / F.col(f"poss{i}")).otherwise(F.lit(0.0))
                          .alias(f"p{i}") for i in range(1, max_order + 1)])
    pcols = [F.col(f"p{i}") for i in range(1, max_order + 1)]
    geo = F.when(F.least(*pcols) > 0, F.exp(sum(F.lit(1.0 / max_order) * F.log(p) for p in pcols))).otherwise(F.lit(0.0))
    ratio = F.col("pred_len") / F.col("ref_len")
    bp = F.when(ratio > 1.0, F.lit(1.0)).otherwise(F.exp(F.lit(1.0) - F.lit(1.0) / ratio))
    return j.select((geo * bp).alias("bleu"), *pcols, bp.alias("bp"),
                    F.col("pred_len").cast("long").alias("pred_len"), F.col("ref_len").cast("long").alias("ref_len"))


def _f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, F.lit(2.0) * p * r / (p + r)).otherwise(F.lit(0.0))


def rouge_n(pairs: DataFrame, orders=(1, 2)) -> DataFrame:
    """L2: per pair ROUGE-n F1 for each order: ``qid, rouge1_f1, rouge2_f1``."""
    ov = _overlap(pairs, rouge_tokens, orders)
    p = F.col("match") / F.greatest(F.col("pred_n"), F.lit(1))
    r = F.col("match") / F.greatest(F.col("ref_n"), F.lit(1))
    f = ov.select("qid", "n", _f1(p, r).alias("f"))
    return f.groupBy("qid").agg(*[F.max(F.when(F.col("n") == n, F.col("f"))).alias(f"rouge{n}_f1") for n in orders])


_POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563,
            0.9994058151824183, 0.999916758850712, 0.9999897508033253)  # the Poisson(1) distribution function at 0 to 7


def resampled_weight(row, replicate) -> Column:
    """How often a row is drawn in a replicate: Poisson(1) from a hash of both, the same wherever it is computed."""
    return _drawn(_uniform(row, replicate))


def _uniform(row, replicate) -> Column:
    h = F.substring(F.md5(F.concat_ws(":", row.cast("string"), replicate.cast("string")).cast("binary")), 1, 8)
    return F.conv(h, 16, 10).cast("double") / F.lit(4294967296.0)


def _drawn(u) -> Column:
    return sum(F.when(u >= p, F.lit(1.0)).otherwise(F.lit(0.0)) for p in _POISSON)


def resampled(scores: DataFrame, id_col: str, columns: list[str], replicates: int = 200, level: float = 0.95) -> DataFrame:
    """Poisson bootstrap of the columns' means in one aggregate, without copies of rows: every row adds one vector
    of its weights and weighted scores, summed map-side. ``(measure, low, mid, high)``: the replicates' means at the
    two ends of ``level`` and at the half, by rank. Replicates that draw no row are left out; null scores
    count as 0; an empty table has null bounds."""
    # the hashes are a list of their own: inside one lambda each of the comparisons would make its hash again
    weights = F.transform(F.transform(F.sequence(F.lit(1), F.lit(replicates)), lambda r: _uniform(F.col(id_col), r)), _drawn)
    # rows are few bytes and much work, so a number of tasks is asked for: by bytes they would meet in one
    spark = scores.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    scores = scores.repartition(tasks)
    s = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns]
    held = scores.select(weights.alias("w"), *[v.alias(f"s{i}") for i, v in enumerate(s)])
    none = scores.sparkSession.range(1).select(F.array_repeat(F.lit(0.0), replicates).alias("w"), *[F.lit(0.0).alias(f"s{i}") for i in range(len(s))])
    held = held.unionByName(none)  # a sum of no vectors is an error
    times = lambda score: F.transform("w", lambda x: x * F.col(score))
    parts = F.concat("w", *[times(f"s{i}") for i in range(len(columns))])
    total = held.select(array_to_vector(parts).alias("x")).agg(vector_to_array(Summarizer.sum(F.col("x"))).alias("t"))
    out = []
    for i, c in enumerate(columns):
        mine = F.slice("t", replicates * (i + 1) + 1, replicates)
        means = F.filter(F.zip_with(mine, F.slice("t", 1, replicates), lambda a, w: F.when(w > 0, a / w)), lambda m: m.isNotNull())
        means = F.array_sort(means)
        place = lambda q: F.try_element_at(means, F.greatest(F.lit(1), F.ceil(F.size(means) * F.lit(q))).cast("int"))
        out.append(F.struct(F.lit(c).alias("measure"), place(round((1 - level) / 2, 9)).alias("low"), place(0.5).alias("mid"),
                            place(round((1 + level) / 2, 9)).alias("high")))
    return total.select(F.inline(F.array(*out)))


def rouge_resampled(pairs: DataFrame, replicates: int = 200, level: float = 0.95) -> DataFrame:
    """L2 as the scoring library reports it by default: bounds and middle of the resampled mean ROUGE-1/2/L."""
    pairs = sizing.materialize(pairs.select("qid", "reference", "prediction"))
    scores = rouge_n(pairs).join(rouge_l(pairs), "qid")
    return resampled(scores, "qid", ["rouge1_f1", "rouge2_f1", "rougeL_f1"], replicates, level)


_BLOCK = 4096  # tokens of the reference that one integer stands for


def _lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence, bit-parallel: tokens of ``b`` are bits of an integer, all 1 at
    first, and a token of ``a`` turns a bit 0 where the subsequence grows, by one add and one xor. Long ones go through block
    by block; what a block carries over to the next at each token of ``a`` is one byte, so memory is linear."""
    carried, zeros = bytearray(len(a)), 0
    for start in range(0, len(b), _BLOCK):
        block = b[start:start + _BLOCK]
        full = (1 << len(block)) - 1
        places: dict = {}
        for i, t in enumerate(block):
            places[t] = places.get(t, 0) | 1 << i
        ones = full
        for k, t in enumerate(a):
            hit = places.get(t)
            if hit is None and not carried[k]:
                continue
            grown = ones & (hit or 0)
            total = ones + grown + carried[k]
            carried[k] = total > full
            ones = total & full | ones ^ grown
        zeros += len(block) - ones.bit_count()
    return zeros


AT_ONCE = 1 << 16  # tokens of both texts that become Python objects at a time, or those of one pair


def _token_pairs(a: pa.Array, b: pa.Array):
    """The pairs of token lists of two Arrow columns, a bounded number of tokens at a time; a null list is an empty one."""
    size = [pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (a, b)]
    for i, j in sizing.pieces(size[0] + size[1] + 1, AT_ONCE):
        for x, y in zip(a[i:j].to_pylist(), b[i:j].to_pylist()):
            yield x or [], y or []


@F.arrow_udf(TY.LongType())
def lcs_length(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([_lcs(x, y) for x, y in _token_pairs(a, b)], pa.int64())


def rouge_l(pairs: DataFrame) -> DataFrame:
    """L3: per pair ROUGE-L F1 from the longest common token subsequence; a null text is an empty one."""
    side = lambda c: rouge_tokens(F.coalesce(F.col(c), F.lit("")))
    t = pairs.select("qid", side("prediction").alias("tp"), side("reference").alias("tr"))
    t = t.withColumn("lcs", lcs_length("tp", "tr"))
    p = F.col("lcs") / F.greatest(F.size("tp"), F.lit(1))
    r = F.col("lcs") / F.greatest(F.size("tr"), F.lit(1))
    return t.select("qid", _f1(p, r).alias("rougeL_f1"))


# ------------------------------------------------------------------ greedy embedding match (L4)

@lru_cache(maxsize=1 << 15)
def _trigram_vec(tok: str, dim: int) -> np.ndarray:
    s = f"<{tok}>"
    v = np.zeros(dim)
    for i in range(max(1, len(s) - 2)):
        g = s[i:i + 3]
        v[int(hashlib.md5(g.encode("utf-8")).hexdigest()[:8], 16) % dim] += 1.0
    n = np.linalg.norm(v)
    return v / n if n > 0 else v


SCORES_AT_ONCE = 1 << 20  # similarities that a task holds at a time


def _greedy(a: list, b: list, dim: int):
    """The mean over the tokens of either side of their best similarity on the other. Equal tokens are compared once, in
    blocks of rows and columns, so memory is bounded by the distinct tokens of the two texts."""
    if not a or not b:
        return 0.0, 0.0
    na, nb = ({t: i for i, t in enumerate(dict.fromkeys(x))} for x in (a, b))
    va, vb = (np.stack([_trigram_vec(t, dim) for t in names]) for names in (na, nb))
    best_a, best_b = np.full(len(na), -np.inf), np.full(len(nb), -np.inf)
    step = 1 << 10
    for i in range(0, len(na), step):
        for j in range(0, len(nb), SCORES_AT_ONCE // step):
            s = va[i:i + step] @ vb[j:j + SCORES_AT_ONCE // step].T
            np.maximum(best_a[i:i + step], s.max(axis=1), out=best_a[i:i + step])
            np.maximum(best_b[j:j + s.shape[1]], s.max(axis=0), out=best_b[j:j + s.shape[1]])
    return float(best_a[[na[t] for t in a]].mean()), float(best_b[[nb[t] for t in b]].mean())


def greedy_match_score(pairs: DataFrame, dim: int = 64) -> DataFrame:
    """L4 re-aimed: token vectors (hashed character trigrams), each token matched to its
    most similar token on the other side; precision / recall are the mean best
    similarities of prediction / reference tokens, F1 their harmonic mean."""

    @F.arrow_udf("p double, r double")
    def score(a: pa.Array, b: pa.Array) -> pa.Array:
        rows = np.array([_greedy(x, y, dim) for x, y in _token_pairs(a, b)], dtype=np.float64).reshape(-1, 2)
        return pa.StructArray.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1])], ["p", "r"])

    t = pairs.select("qid", score(rouge_tokens(F.col("prediction")), rouge_tokens(F.col("reference"))).alias("s"))
    p, r = F.col("s.p"), F.col("s.r")
    return t.select("qid", p.alias("greedy_precision"), r.alias("greedy_recall"), _f1(p, r).alias("greedy_f1"))


# ------------------------------------------------------------------ ranking metrics

def relevance_by_group(hits: DataFrame, items: DataFrame, queries: DataFrame, group_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """Relevance "same group, other item" for queries that are items themselves: flags each hit and
    counts relevant items per query from group sizes, without listing relevant pairs."""
    g = items.select(F.col("chunk_id"), F.col(group_col).alias("grp"))
    qg = g.select(F.col("chunk_id").alias("query_id"), F.col("grp").alias("qgrp"))
    flagged = hits.join(g, "chunk_id").join(qg, "query_id").select(
        "query_id", "chunk_id", "rank", ((F.col("grp") == F.col("qgrp")) & (F.col("chunk_id") != F.col("query_id")))
        .alias("relevant"))
    sizes = g.groupBy("grp").agg((F.count(F.lit(1)) - 1).alias("n_relevant"))
    n_rel = qg.join(queries.select("query_id"), "query_id", "left_semi").join(
        sizes, F.col("qgrp") == F.col("grp")).select("query_id", "n_relevant")
    return flagged, n_rel


def recall_at_k(flagged: DataFrame, n_rel: DataFrame, k: int) -> DataFrame:
    """Mean over queries with relevant items of |relevant hits ranked <= k| / |relevant|."""
    got = flagged.where(F.col("relevant") & (F.col("rank") <= k)).groupBy("query_id").agg(F.count(F.lit(1)).alias("g"))
    per_q = n_rel.where(F.col("n_relevant") > 0).join(got, "query_id", "left").select(
        (F.coalesce("g", F.lit(0)) / F.col("n_relevant")).alias("recall"))
    return per_q.agg(F.lit(k).cast("long").alias("k"), F.avg("recall").alias("recall"),
                     F.count(F.lit(1)).alias("n_queries"))


def mrr(flagged: DataFrame, n_rel: DataFrame) -> DataFrame:
    """Mean over queries with relevant items of 1 / rank of the first relevant hit (0 if none)."""
    first = flagged.where("relevant").groupBy("query_id").agg(F.min("rank").alias("r"))
    per_q = n_rel.where(F.col("n_relevant") > 0).join(first, "query_id", "left").select(
        F.coalesce(F.lit(1.0) / F.col("r"), F.lit(0.0)).alias("rr"))
    return per_q.agg(F.avg("rr").alias("mrr"), F.count(F.lit(1)).alias("n_queries"))


REPORT_COLUMNS = ("query", "answer_reference", "answer_prediction", "sources_prediction", "bert_precision", "bert_recall",
                  "bert_f1", "bleu", "rouge1_f1", "rouge2_f1", "rougeL_f1")


def eval_report(pairs: DataFrame, max_order: int = 4) -> DataFrame:
    """The report's 11 columns and ``qid``, one row per question: the answers, the sources (column
    ``sources`` of ``pairs``, ``null`` without), the greedy match per row (in the place of a
    model's score), and the corpus BLEU and mean ROUGE-1/2/L repeated on every row."""
    b = bleu(pairs, max_order).select("bleu")
    means = rouge_n(pairs).agg(F.avg("rouge1_f1").alias("rouge1_f1"), F.avg("rouge2_f1").alias("rouge2_f1"))
    longest = rouge_l(pairs).agg(F.avg("rougeL_f1").alias("rougeL_f1"))
    match = greedy_match_score(pairs).select("qid", F.col("greedy_precision").alias("bert_precision"),
                                             F.col("greedy_recall").alias("bert_recall"), F.col("greedy_f1").alias("bert_f1"))
    sources = F.col("sources") if "sources" in pairs.columns else F.lit(C.NO_SOURCES)
    rows = pairs.select("qid", F.col("question").alias("query"), F.col("reference").alias("answer_reference"),
                        F.col("prediction").alias("answer_prediction"), sources.alias("sources_prediction"))
    for scalars in (b, means, longest):
        rows = attach_scalars(rows, scalars)
    return rows.join(match, "qid").select("qid", *REPORT_COLUMNS)


def attach_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Append the columns of a one-row aggregate to every row (broadcast of one row)."""
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(one_row.withColumn("_one", F.lit(1))), "_one").drop("_one")
