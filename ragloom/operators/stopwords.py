"""Stop words per text search configuration, and configuration-aware postings.

The word lists are files of this package (``data/stopwords``, one per configuration, the ones
Spark ML ships for ``StopWordsRemover``), so Spark and the SQL twins use the same lists whatever
the installation. Configurations without a list (``simple``, or a language Spark has no list
for) remove nothing. Stems are a dictionary made by ``stemming``.
"""

from __future__ import annotations

from functools import lru_cache
from importlib import resources

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom.functions import text as T

CONFIGS = ("Danish", "Dutch", "English", "Finnish", "French", "Hungarian", "Italian", "Norwegian", "Portuguese",
           "Russian", "Spanish", "Swedish", "Turkish")


@lru_cache(maxsize=None)
def word_lists() -> dict[str, tuple[str, ...]]:
    """configuration name -> stop words (lower case), for configurations that have a list.
    A missing file raises."""
    folder = resources.files("ragloom").joinpath("data").joinpath("stopwords")
    return {c: tuple(folder.joinpath(f"{c}.txt").read_text(encoding="utf-8").split("\n")[:-1]) for c in CONFIGS}


def stop_table(spark) -> DataFrame:
    rows = [(cfg, w) for cfg, ws in word_lists().items() for w in ws]
    return spark.createDataFrame(rows, "config string, tok string")


def config_postings(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "content",
                    config_col: str = "config", fold_accents: bool = True, stems: DataFrame | None = None) -> DataFrame:
    """Postings ``(chunk_id, pos, tok)`` of (by default accent-folded) content, stop words of each
    chunk's configuration removed after numbering (they keep their positions). With ``stems`` (a
    ``(config, tok, stem)`` table, see ``stemming``) the other tokens are replaced by their stems."""
    p = chunks.select(
        F.col(id_col).alias("chunk_id"), F.col(config_col).alias("config"),
        F.posexplode(T.tokens(text_col, fold_accents=fold_accents)).alias("pos", "tok"),
    ).select("chunk_id", "config", (F.col("pos") + 1).cast("long").alias("pos"), "tok")
    # the stop table is a fixed dictionary (a few thousand words), so broadcasting it is bounded
    sw = F.broadcast(stop_table(chunks.sparkSession))
    p = p.join(sw, ["config", "tok"], "left_anti")
    if stems is not None:
        from ragloom.operators import stemming

        p = stemming.apply(p, stems)
    return p.select("chunk_id", "pos", "tok")


def stop_values_sql() -> str:
    parts = [f"SELECT '{cfg}' AS config, unnest([{', '.join(T._lit_sql(w) for w in ws)}]) AS tok"
             for cfg, ws in word_lists().items()]
    return "(" + " UNION ALL ".join(parts) + ")"


def config_postings_sql(chunks_view: str, stems: bool = False) -> str:
    cfg = T.language_config_sql("language")
    kept = f"""(
        SELECT p.chunk_id, p.config, p.pos, p.tok FROM (
          SELECT chunk_id, config, unnest(tk) AS tok, generate_subscripts(tk, 1) AS pos
          FROM (SELECT chunk_id, {cfg} AS config, {T.tokens_sql('content', True)} AS tk FROM {chunks_view})
        ) p
        LEFT JOIN {stop_values_sql()} sw ON sw.config = p.config AND sw.tok = p.tok
        WHERE sw.tok IS NULL)"""
    if stems:
        from ragloom.operators import stemming

        kept = stemming.stem_table_sql(kept)
    return f"SELECT chunk_id, pos, tok FROM {kept}"
