"""Stems per text search configuration (F1): suffix rules, run once on the distinct tokens of a table.

A rule is (suffix, replacement, least length of what stays before the suffix). A configuration has steps, each a list
of rules of which the first that fits applies; tokens of configurations without rules stay as they are. Tokens are
accent-folded before, so suffixes have no accents. ``dictionary`` makes ``(config, tok, stem)`` rows for the tokens that change;
``apply`` joins it back. ``hook`` makes such a dictionary by the user's own stemmer instead.

These are light rules for inflection, not the rules of any particular stemmer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom.functions import text as T
from ragloom.operators import sizing

RULES: dict[str, tuple[tuple[tuple[str, str, int], ...], ...]] = {
    "English": (
        (("sses", "ss", 2), ("ies", "y", 2), ("shes", "sh", 2), ("ches", "ch", 2), ("xes", "x", 2), ("ss", "ss", 1), ("us", "us", 1),
         ("is", "is", 1), ("s", "", 3)),
        (("ingly", "", 4), ("edly", "", 4), ("ing", "", 4), ("ied", "y", 2), ("eed", "eed", 1), ("ed", "", 4), ("ly", "", 4)),
        (("e", "", 3),),
    ),
    "French": (
        (("eaux", "eau", 1), ("aux", "al", 2), ("s", "", 3), ("x", "", 3)),
        (("issement", "", 3), ("ement", "", 3), ("ation", "", 4), ("ees", "", 3), ("ee", "", 3), ("er", "", 4), ("ent", "", 4), ("e", "", 3)),
    ),
    "German": (
        (("erinnen", "", 3), ("innen", "", 3), ("ungen", "ung", 2), ("heiten", "heit", 2), ("ern", "", 3), ("en", "", 3), ("er", "", 3),
         ("em", "", 3), ("es", "", 3), ("e", "", 3), ("n", "", 4), ("s", "", 4)),
    ),
    "Spanish": (
        (("aciones", "acion", 2), ("iones", "ion", 2), ("ces", "z", 2), ("es", "", 3), ("s", "", 3)),
        (("amente", "", 3), ("mente", "", 4), ("ando", "", 3), ("iendo", "", 3), ("ado", "", 3), ("ada", "", 3), ("ido", "", 3), ("ida", "", 3),
         ("ar", "", 3), ("er", "", 3), ("ir", "", 3), ("a", "", 3), ("o", "", 3), ("e", "", 3)),
    ),
    "Italian": (
        (("amente", "", 3), ("mente", "", 4), ("azioni", "azion", 2), ("azione", "azion", 2), ("ando", "", 3), ("endo", "", 3), ("ato", "", 3), ("ata", "", 3),
         ("ati", "", 3), ("ate", "", 3), ("are", "", 3), ("ere", "", 3), ("ire", "", 3), ("i", "", 3), ("e", "", 3), ("a", "", 3), ("o", "", 3)),
    ),
    "Portuguese": (
        (("acoes", "acao", 2), ("oes", "ao", 2), ("ais", "al", 2), ("es", "", 4), ("s", "", 3)),
        (("amente", "", 3), ("mente", "", 4), ("ando", "", 3), ("endo", "", 3), ("ado", "", 3), ("ada", "", 3), ("ar", "", 3), ("er", "", 3), ("ir", "", 3),
         ("a", "", 3), ("o", "", 3), ("e", "", 3)),
    ),
    "Dutch": ((("heden", "heid", 2), ("ingen", "ing", 2), ("en", "", 3), ("s", "", 3), ("e", "", 3)),),
}


def step_sql(step: int, tok: str = "tok", config: str = "config") -> str:
    """A token after one step of its configuration's rules, as an expression that Spark and DuckDB both evaluate."""
    whens = []
    for name, steps in RULES.items():
        if step < len(steps):
            fits = " ".join(f"WHEN right({tok}, {len(suf)}) = '{suf}' AND length({tok}) >= {len(suf) + least} "
                            f"THEN left({tok}, length({tok}) - {len(suf)}) || '{rep}'" for suf, rep, least in steps[step])
            whens.append(f"WHEN {config} = '{name}' THEN CASE {fits} ELSE {tok} END")
    return f"CASE {' '.join(whens)} ELSE {tok} END"


N_STEPS = max(len(steps) for steps in RULES.values())


def stem_table_sql(view: str) -> str:
    """The twin: ``view``'s columns with ``tok`` replaced by its stem."""
    for i in range(N_STEPS):
        view = f"(SELECT * REPLACE ({step_sql(i)} AS tok) FROM {view})"
    return view


def vocabulary(texts: DataFrame, text_col: str, config_col: str = "config", fold_accents: bool = True) -> DataFrame:
    """The distinct ``(config, tok)`` of a table of texts; tokens combine in their text, then before the exchange."""
    toks = F.array_distinct(T.tokens(text_col, fold_accents=fold_accents))
    # explode_outer: for explode, Spark adds a filter that splits the texts twice more
    return texts.select(F.col(config_col).alias("config"), F.explode_outer(toks).alias("tok")).where("tok is not null").distinct()


def dictionary(vocab: DataFrame) -> DataFrame:
    """``(config, tok, stem)`` by the rules; a table in the shared folder."""
    rows = vocab.select("config", "tok", F.col("tok").alias("stem"))
    for i in range(N_STEPS):
        # in a lambda the step's input is one reference, so steps that the optimizer merges don't multiply
        rows = rows.withColumn("stem", F.expr(f"transform(array(stem), x -> {step_sql(i, 'x')})[0]"))
    return sizing.materialize(rows.where("stem <> tok"))


def hook(vocab: DataFrame, stem: Callable[[str, pd.Series], pd.Series]) -> DataFrame:
    """A dictionary by ``stem(config, tokens) -> stems``, called on Arrow batches of one configuration's distinct tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for config, rows in pdf.groupby("config", dropna=False):
                yield rows.assign(stem=stem(config, rows["tok"]))

    out = vocab.select("config", "tok").mapInPandas(run, "config string, tok string, stem string")
    return sizing.materialize(out.where("stem is not null and stem <> tok"))


def apply(rows: DataFrame, stems: DataFrame) -> DataFrame:
    """``rows`` (with ``config`` and ``tok``) with tokens replaced by their stems. The dictionary is broadcast if its
    measured bytes fit; else both sides meet by token, where adaptive execution splits the frequent ones."""
    small = F.broadcast(stems) if sizing.measured_bytes(stems, "tok", "stem", "config") <= sizing.broadcast_limit(stems) else stems
    return rows.join(small, ["config", "tok"], "left").withColumn("tok", F.coalesce("stem", "tok")).drop("stem")
