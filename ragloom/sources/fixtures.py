"""Derived inputs built from the driver tables, in Spark and as DuckDB CTEs.

The reference reads PDFs and a PostgreSQL chunk table; the test tables give
``documents`` (one row per page of a file named by ``source``), ``embeddings``
(unit vectors keyed like documents) and ``conversations``. The rules here turn
them into the shapes the operators take. Every SQL twin computes the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ragloom.functions import text as T
from ragloom.sources.tables import page_table, read_table

QUERY_EVERY = 50

# ------------------------------------------------------------------ Spark side


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``page_table``: documents numbered per source by doc_id, blank pages dropped."""
    docs = read_table(spark, sf_dir, "documents", spread_key="doc_id").select("doc_id", "source", "text", "lang")
    return page_table(docs, order_col="doc_id")


def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One messy PDF file name per document, as users upload them."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source")
    return docs.select(
        "doc_id",
        F.concat(F.lit("Doc ["), F.col("source"), F.lit("], (v"), (F.col("doc_id") % 3).cast("string"),
                 F.lit(")  final.pdf")).alias("file_name"),
    )


def loaded_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files already in the chunk table: every fourth document's file (by doc_id)."""
    return file_names(spark, sf_dir).where(F.col("doc_id") % 4 == 0)


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``chunks``: all pages, one chunk per page, with a vector where there is one.

    Columns: chunk_id, source, page_number, content (cleaned), language, embedding, label.
    """
    p = pages(spark, sf_dir)
    e = read_table(spark, sf_dir, "embeddings")
    return p.join(e, p.doc_id == e.vec_id, "left").select(
        F.col("doc_id").alias("chunk_id"),
        "source",
        "page_number",
        T.clean_text("text").alias("content"),
        F.col("lang").alias("language"),
        "embedding",
        "label",
    )


def search_queries(spark: SparkSession, sf_dir: str, chunk_df: DataFrame | None = None) -> DataFrame:
    """A query for every chunk whose id is divisible by 50: its two most frequent words (>= 4
    letters, in >= 2 chunks), ties by word; the query vector is the chunk's own embedding, if any.

    Columns: query_id, query_text, query_vec.
    """
    ch = chunk_df if chunk_df is not None else chunks(spark, sf_dir)
    asked = ch.where(F.col("chunk_id") % QUERY_EVERY == 0)
    # explode_outer: for explode, Spark adds a filter that splits the texts twice more
    tf = asked.select("chunk_id", F.explode_outer(T.tokens("content", fold_accents=True)).alias("tok")).where("tok is not null").groupBy(
        "chunk_id", "tok").agg(F.count(F.lit(1)).alias("tf"))
    # a chunk counts a word once, so words combine before the exchange
    words = ch.select(F.explode_outer(F.array_distinct(T.tokens("content", fold_accents=True))).alias("tok"))
    dfreq = words.where("tok is not null").groupBy("tok").agg(F.count(F.lit(1)).alias("n_docs")).where("n_docs >= 2").select("tok")
    cand = tf.where(F.col("tok").rlike(r"^\p{L}{4,}$")).join(dfreq, "tok", "left_semi")
    w = Window.partitionBy("chunk_id").orderBy(F.col("tf").desc(), F.col("tok"))
    top = cand.withColumn("r", F.row_number().over(w)).where("r <= 2")
    text = top.groupBy("chunk_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "tok"))), lambda s: s["tok"]), " ")
        .alias("query_text"))
    return text.join(ch.select("chunk_id", "embedding"), "chunk_id").select(
        F.col("chunk_id").alias("query_id"), "query_text", F.col("embedding").alias("query_vec"))


def qa_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user turn directly followed by an assistant turn is a (question, answer) pair.

    Columns: qid = conv_id * 100000 + turn, conv_id, turn, question, answer.
    """
    conv = read_table(spark, sf_dir, "conversations", spread_key="conv_id")
    u = conv.where(F.col("role") == "user").alias("u")
    a = conv.where(F.col("role") == "assistant").alias("a")
    return u.join(a, (F.col("u.conv_id") == F.col("a.conv_id")) & (F.col("a.turn") == F.col("u.turn") + 1)).select(
        (F.col("u.conv_id") * 100000 + F.col("u.turn")).alias("qid"),
        F.col("u.conv_id").alias("conv_id"),
        F.col("u.turn").alias("turn"),
        F.col("u.text").alias("question"),
        F.col("a.text").alias("answer"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixture predictions for the metric checks: for even ``conv_id + turn / 2`` the
    first two thirds of the reference answer's words, otherwise the question itself.

    Columns: qid, question, reference, prediction.
    """
    qa = qa_pairs(spark, sf_dir)
    words = F.split(T.squash_ws("answer"), " ")
    n = F.size(words)
    head = F.array_join(F.slice(words, 1, F.greatest((n * 2) / 3, F.lit(0)).cast("int")), " ")
    even = ((F.col("conv_id") + F.floor(F.col("turn") / 2)) % 2) == 0
    return qa.select("qid", "question", F.col("answer").alias("reference"),
                     F.when(even & (n >= 3), head).otherwise(F.col("question")).alias("prediction"))


# ------------------------------------------------------------------ SQL side
# name -> (dependencies, body). ``with_ctes`` orders them.

_BLANK = T.is_blank_sql("text")

SQL_CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "pages": ((), f"""
        SELECT doc_id, source, text, lang,
               row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page_number
        FROM documents"""),
    "pages_nb": (("pages",), f"SELECT * FROM pages WHERE NOT {_BLANK}"),
    "file_names": ((), """
        SELECT doc_id, 'Doc [' || source || '], (v' || CAST(doc_id % 3 AS VARCHAR) || ')  final.pdf' AS file_name
        FROM documents"""),
    "loaded_files": (("file_names",), "SELECT * FROM file_names WHERE doc_id % 4 = 0"),
    "chunks": (("pages_nb",), f"""
        SELECT p.doc_id AS chunk_id, p.source, p.page_number, {T.clean_text_sql('p.text')} AS content,
               p.lang AS language, e.embedding::DOUBLE[] AS embedding, e.label
        FROM pages_nb p LEFT JOIN embeddings e ON p.doc_id = e.vec_id"""),
    "chunk_toks": (("chunks",), f"SELECT chunk_id, unnest({T.tokens_sql('content', True)}) AS tok FROM chunks"),
    "chunk_tf": (("chunk_toks",), "SELECT chunk_id, tok, count(*) AS tf FROM chunk_toks GROUP BY chunk_id, tok"),
    "queries": (("chunk_tf", "chunks"), """
        SELECT t.chunk_id AS query_id, t.query_text, c.embedding AS query_vec
        FROM (
          SELECT chunk_id, string_agg(tok, ' ' ORDER BY r) AS query_text
          FROM (
            SELECT tf.chunk_id, tf.tok,
                   row_number() OVER (PARTITION BY tf.chunk_id ORDER BY tf.tf DESC, tf.tok) AS r
            FROM chunk_tf tf
            WHERE tf.chunk_id % 50 = 0 AND regexp_full_match(tf.tok, '\\p{L}{4,}')
              AND tf.tok IN (SELECT tok FROM chunk_tf GROUP BY tok HAVING count(*) >= 2)
          ) WHERE r <= 2
          GROUP BY chunk_id
        ) t JOIN chunks c ON c.chunk_id = t.chunk_id"""),
    "qa_pairs": ((), """
        SELECT u.conv_id * 100000 + u.turn AS qid, u.conv_id, u.turn, u.text AS question, a.text AS answer
        FROM conversations u JOIN conversations a
          ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
        WHERE u.role = 'user'"""),
    "predictions": (("qa_pairs",), f"""
        SELECT qid, question, answer AS reference,
               CASE WHEN (conv_id + floor(turn / 2)) % 2 = 0 AND len(w) >= 3
                    THEN array_to_string(w[1:CAST(floor(len(w) * 2 / 3) AS INTEGER)], ' ')
                    ELSE question END AS prediction
        FROM (SELECT *, string_split({T.squash_ws_sql('answer')}, ' ') AS w FROM qa_pairs)"""),
}


def with_ctes(*names: str, extra: dict[str, tuple[tuple[str, ...], str]] | None = None) -> str:
    """``WITH a AS (...), b AS (...)`` for the named CTEs and everything they need."""
    defs = dict(SQL_CTES)
    if extra:
        defs.update(extra)
    ordered: list[str] = []

    def visit(n: str) -> None:
        if n in ordered:
            return
        for d in defs[n][0]:
            visit(d)
        ordered.append(n)

    for n in names:
        visit(n)
    return "WITH " + ",\n".join(f"{n} AS ({defs[n][1]})" for n in ordered) + "\n"
