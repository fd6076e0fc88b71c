"""Language detection (B10) as a Spark job: character-trigram naive Bayes.

A trigram has one of ``SLOTS`` slots, by its code points. Train: slots' counts per language of labelled
text. Score: ``score(text, l) = sum_g c_g * ln((n(l, slot(g)) + 1) / (T_l + V))`` with add-one
smoothing, V the slots in use. The model has one row per slot in use with a weight for each language, so it is
of fixed size whatever the corpus, and is broadcast to the texts: a trigram is scored where its text is read
and only a text's sums are exchanged, never its trigrams. The best language wins (ties by code); a text
without letters is a detection failure (NULL -> ``simple``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragloom.functions import text as T
from ragloom.functions.numeric import round_half_up
from ragloom.operators import sizing

SLOTS = 1 << 16


def words(c) -> Column:
    """Lower-cased runs of letters."""
    s = F.lower(F.col(c) if isinstance(c, str) else c)
    return F.filter(F.split(s, r"[^\p{L}]+"), lambda w: w != F.lit(""))


def words_sql(e: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({e}), '[^\\p{{L}}]+'), lambda w: w <> '')"


def trigrams(word: str) -> Column:
    """Character trigrams of one word padded with a space on each side. Words are
    short, so positional ``substring`` stays cheap (on a whole text it would walk
    the UTF-8 bytes from the start for every position)."""
    s = F.concat(F.lit(" "), F.col(word), F.lit(" "))
    return F.transform(F.sequence(F.lit(1), F.length(s) - 2), lambda i: F.substring(s, i, 3))


def slot(gram: str) -> Column:
    """The slot of a trigram, from its three code points."""
    at = lambda i: F.ascii(F.substring(gram, i, 1)).cast("long")
    return ((at(1) * 961 + at(2) * 31 + at(3)) % SLOTS).cast("int")


def slot_sql(gram: str) -> str:
    at = lambda i: f"unicode(substring({gram}, {i}, 1))"
    return f"(({at(1)} * 961 + {at(2)} * 31 + {at(3)}) % {SLOTS})"


def _slots(df: DataFrame, keep: list, text_col: str) -> DataFrame:
    # explode_outer: for explode, Spark adds a filter that splits the texts twice more
    w = df.select(*keep, F.explode_outer(words(text_col)).alias("_w")).where("_w is not null")
    return w.select(*keep, F.explode_outer(trigrams("_w")).alias("_gram")).select(*keep, slot("_gram").alias("slot"))


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Model rows ``(slot, weights)``, at most ``SLOTS``: ``weights`` has for each language with text, by code, a
    struct ``(lang, w = ln(1 + n), base = ln(T_lang + V))``. Words are counted first, combined before their exchange, so
    only a language's distinct words are cut into trigrams; the slots' counts are written once. Rows without a language are left out."""
    said = labelled.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.explode_outer(words(text_col)).alias("_w"))
    said = said.where("_w is not null").groupBy("lang", "_w").agg(F.count(F.lit(1)).alias("_c"))
    g = said.select("lang", "_c", F.explode_outer(trigrams("_w")).alias("_gram")).select("lang", "_c", slot("_gram").alias("slot"))
    counts = sizing.materialize(g.groupBy("lang", "slot").agg(F.sum("_c").alias("n")))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("t"))
    used = counts.select("slot").distinct()
    bases = totals.crossJoin(F.broadcast(used.agg(F.count(F.lit(1)).alias("v")))).select(  # one row
        "lang", F.log(F.col("t") + F.col("v")).alias("base"))
    grid = used.crossJoin(F.broadcast(bases))  # one row per language
    cells = grid.join(counts, ["lang", "slot"], "left").select(
        "slot", F.struct("lang", F.log(F.coalesce("n", F.lit(0)) + F.lit(1)).alias("w"), "base").alias("c"))
    return cells.groupBy("slot").agg(F.array_sort(F.collect_list("c")).alias("weights"))


def detect(texts: DataFrame, model: DataFrame, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """``(*id_cols, lang)`` for every input row; ``lang`` is NULL when the text has no letters, or the model is empty."""
    one = model.select("weights").head()
    langs = [(c.lang, c.base) for c in one.weights] if one else []  # one per language of the model
    if not langs:
        return texts.select(*id_cols, F.lit(None).cast("string").alias("lang"))
    rows = model.select("slot", *[F.col("weights")[i].w.alias(f"_w{i}") for i in range(len(langs))])
    scored = _slots(texts, list(id_cols), text_col).join(F.broadcast(rows), "slot", "left").groupBy(*id_cols).agg(
        F.count(F.lit(1)).alias("_n"), *[F.coalesce(F.sum(f"_w{i}"), F.lit(0.0)).alias(f"_s{i}") for i in range(len(langs))])
    each = F.array(*[F.struct(round_half_up(F.col(f"_s{i}") - F.col("_n") * F.lit(base), 6).alias("s"), F.lit(lang).alias("lang"))
                     for i, (lang, base) in enumerate(langs)])
    best = scored.select(*id_cols, F.array_max(each).lang.alias("lang"))
    return texts.select(*id_cols).join(best, id_cols, "left")


def with_config(detected: DataFrame) -> DataFrame:
    """B9 on the detected code: ``config``."""
    return detected.withColumn("config", T.language_config("lang"))
