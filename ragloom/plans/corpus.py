"""Registered corpus queries: sources (A), scalar functions (B), ingest checks (E)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ragloom import constants as C
from ragloom.functions import text as T
from ragloom.functions import vectors as V
from ragloom.operators import ingest, langdetect, sizing, stopwords
from ragloom.plans.common import r6, r6_sql, register
from ragloom.plans.detect import detect_ctes
from ragloom.session import scratch_path
from ragloom.sources import fixtures as X
from ragloom.sources.tables import page_files, read_table

DEST = "/data/loaded"


def _docs(spark, sf):
    return read_table(spark, sf, "documents")


# ------------------------------------------------------------------ A: sources

def q_page_table(spark, sf):
    return X.pages(spark, sf).select("doc_id", "source", "page_number")


VOLUME = 50  # ids of a volume, one page file each
# A local folder gets no checksum file beside each page file, for whose mode Hadoop would start a process each; other
# file systems don't use these options.
MANY_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def q_page_files(spark, sf):
    """Documents as page files, a file for each source and volume, written and read back by their pages."""
    d = _docs(spark, sf).select("source", F.floor(F.col("doc_id") / VOLUME).alias("volume"), "doc_id",
                                F.replace("text", F.lit("\f"), F.lit(" ")).alias("value"))
    folder = scratch_path(spark, f"page-files-{uuid.uuid4().hex}")
    # volumes above sources: they are many, so one job lists their folders; by range, as a volume's folder that one task
    # wrote is moved to its place as a whole
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (d.repartitionByRange(n, "volume", "source").sortWithinPartitions("volume", "source", "doc_id").drop("doc_id")
     .write.partitionBy("volume", "source").options(**MANY_FILES).option("lineSep", "\f").text(folder))
    return page_files(spark, folder, keep=("source", "volume")).select(
        "source", F.col("volume").cast("long").alias("volume"), "page_number", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def q_qa_pairs(spark, sf):
    return X.qa_pairs(spark, sf).select("qid", "question", "answer")


def q_vector_codec(spark, sf):
    e = read_table(spark, sf, "embeddings")
    back = V.text_to_vector(V.vector_to_text("embedding"))
    return e.select("vec_id", F.size("embedding").cast("long").alias("n_dims"),
                    (back == F.col("embedding")).alias("roundtrip_ok"))


def _loaded_table(spark, sf, files=None):
    ch = X.chunks(spark, sf)
    files = X.loaded_files(spark, sf) if files is None else files
    named = ch.join(files, ch.chunk_id == files.doc_id).drop("source", "doc_id").withColumnRenamed(
        "file_name", "source")
    return ingest.chunk_rows(named, strategy="recursive")


def q_chunk_table(spark, sf):
    return _loaded_table(spark, sf, X.file_names(spark, sf)).drop("embedding")


def q_reset_append(spark, sf):
    """Two strategies: one loaded, appended and reset, the other loaded, appended and reset without rows; a third stays."""
    rows = sizing.materialize(_loaded_table(spark, sf, X.file_names(spark, sf)).drop("strategy"))
    of = lambda name: rows.withColumn("strategy", F.lit(name))
    path = scratch_path(spark, f"reset/{uuid.uuid4().hex}")
    for name, reset in (("first", True), ("second", False), ("third", False), ("first", False), ("second", False), ("third", False), ("first", True)):
        ingest.write_chunks(of(name), path, reset, strategy=name)
    ingest.write_chunks(of("second").limit(0), path, True, strategy="second")
    table = spark.read.schema(ingest.CHUNK_SCHEMA).parquet(path)
    return table.groupBy("strategy", "hash_value").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("chunk_id").alias("n_chunks"))


def q_vectors_by_source(spark, sf):
    v = ingest.vectors_by_source(_loaded_table(spark, sf, X.file_names(spark, sf)), dim=64)
    return r6(v.select("source", "chunk_id", F.posexplode("embedding").alias("idx", "value")).select(
        "source", "chunk_id", F.col("idx").cast("long").alias("idx"), F.col("value").cast("double").alias("value")), "value")


def q_embeddings_by_source(spark, sf):
    return ingest.embeddings_by_source(_loaded_table(spark, sf, X.file_names(spark, sf)), dim=64)


# ------------------------------------------------------------------ B: functions

def q_clean_filename(spark, sf):
    f = X.file_names(spark, sf)
    return f.select("doc_id", "file_name", T.clean_filename("file_name").alias("clean_name"))


def q_file_hash(spark, sf):
    return X.file_names(spark, sf).select("doc_id", T.file_hash("file_name").alias("hash_value"))


def q_rename_plan(spark, sf):
    f = X.file_names(spark, sf)
    new = T.bounded_filename("file_name")
    return f.select("doc_id", F.col("file_name").alias("original"), new.alias("new_name"),
                    (F.col("file_name") != new).alias("renamed"),
                    F.concat(F.lit(DEST + "/"), new).alias("destination"))


def q_clean_text(spark, sf):
    return _docs(spark, sf).select("doc_id", T.clean_text("text").alias("content"))


def q_language_config(spark, sf):
    return _docs(spark, sf).select("doc_id", "lang", T.language_config("lang").alias("config"))


def q_normalize_text(spark, sf):
    c = read_table(spark, sf, "conversations")
    return c.select("conv_id", "turn", T.normalize("text").alias("normalized"))


def q_clean_snippet(spark, sf):
    ch = X.chunks(spark, sf)
    return ch.select("chunk_id", T.clean_snippet(F.left("content", F.lit(C.CHUNK_SIZE))).alias("snippet"))


def q_double_url_encode(spark, sf):
    ch = X.chunks(spark, sf)
    snip = T.clean_snippet(F.left("content", F.lit(C.CHUNK_SIZE)))
    return ch.select("chunk_id", T.double_url_encode(snip).alias("highlight"),
                     T.url_quote("source", keep_slash=True).alias("file"))


def q_query_guard(spark, sf):
    c = read_table(spark, sf, "conversations").where(F.col("role") == "user")
    blank = T.is_blank("text")
    return c.select("conv_id", "turn", blank.alias("blank"),
                    F.when(blank, F.lit(C.EMPTY_QUERY_REPLY)).alias("reply"))


def q_unaccent(spark, sf):
    return _docs(spark, sf).select("doc_id", T.unaccent("text").alias("folded"))


def q_text_vector(spark, sf):
    ch = X.chunks(spark, sf).withColumn("config", T.language_config("language"))
    return stopwords.config_postings(ch)


# ------------------------------------------------------------------ E: ingest checks

def _batch(spark, sf):
    return X.file_names(spark, sf)


def q_already_loaded(spark, sf):
    return ingest.already_loaded(_batch(spark, sf), _loaded_table(spark, sf)).select("doc_id", "file_name", "loaded")


def q_new_files_only(spark, sf):
    return ingest.new_files_only(_batch(spark, sf), _loaded_table(spark, sf))


def q_ingest_report(spark, sf):
    return ingest.ingest_report(_batch(spark, sf), _loaded_table(spark, sf))


# ------------------------------------------------------------------ SQL twins

_CLEAN = T.clean_filename_sql("file_name")
CORPUS_CTES = {
    "whole_table": (("chunks", "file_names"), f"""
        SELECT c.chunk_id, {T.clean_text_sql('c.content')} AS content,
               {T.clean_filename_sql('f.file_name')} AS source, c.page_number,
               {T.language_config_sql('c.language')} AS language,
               {T.file_hash_sql('f.file_name')} AS hash_value, 'recursive' AS strategy, c.embedding
        FROM chunks c JOIN file_names f ON f.doc_id = c.chunk_id"""),
    "loaded_table": (("whole_table",), "SELECT * FROM whole_table WHERE chunk_id % 4 = 0"),
    "batch": (("file_names",), f"SELECT doc_id, file_name, {T.file_hash_sql('file_name')} AS hash_value FROM file_names"),
}


def ctes(*names):
    return X.with_ctes(*names, extra=CORPUS_CTES)


register("page_table", q_page_table, X.with_ctes("pages_nb") + "SELECT doc_id, source, page_number FROM pages_nb")
register("page_files", q_page_files, f"""
    SELECT source, volume, page_number, md5(text) AS text_md5
    FROM (SELECT source, doc_id // {VOLUME} AS volume, replace(text, chr(12), ' ') AS text,
                 row_number() OVER (PARTITION BY source, doc_id // {VOLUME} ORDER BY doc_id) AS page_number FROM documents)
    WHERE NOT {T.is_blank_sql('text')}""")
register("qa_pairs", q_qa_pairs, X.with_ctes("qa_pairs") + "SELECT qid, question, answer FROM qa_pairs")
register("vector_codec", q_vector_codec, """
    SELECT vec_id, len(embedding)::BIGINT AS n_dims,
           CAST(CAST(embedding AS VARCHAR) AS FLOAT[]) = embedding AS roundtrip_ok FROM embeddings""")
register("chunk_table", q_chunk_table, ctes("whole_table") +
         "SELECT chunk_id, content, source, page_number, language, hash_value, strategy FROM whole_table")
register("reset_append", q_reset_append, ctes("whole_table") + """
    SELECT s AS strategy, hash_value, count(*) * n AS n_rows, count(DISTINCT chunk_id) AS n_chunks
    FROM whole_table, (VALUES ('first', 1), ('third', 2)) v(s, n) GROUP BY s, n, hash_value""")
register("vectors_by_source", q_vectors_by_source, ctes("whole_table") + f"""
    SELECT source, chunk_id, CAST(i - 1 AS BIGINT) AS idx, {r6_sql('CAST(embedding[i] AS DOUBLE)')} AS value
    FROM (SELECT source, chunk_id, embedding, generate_subscripts(embedding, 1) AS i FROM whole_table WHERE embedding IS NOT NULL)""")
register("embeddings_by_source", q_embeddings_by_source, ctes("whole_table") + """
    SELECT source, count(*) AS n_vectors, min(hash_value) AS hash_value, sum(len(embedding))::BIGINT AS n_values
    FROM whole_table GROUP BY source""")
register("clean_filename", q_clean_filename, X.with_ctes("file_names") +
         f"SELECT doc_id, file_name, {_CLEAN} AS clean_name FROM file_names")
register("file_hash", q_file_hash, X.with_ctes("file_names") +
         f"SELECT doc_id, {T.file_hash_sql('file_name')} AS hash_value FROM file_names")
_NEW = T.bounded_filename_sql("file_name")
register("rename_plan", q_rename_plan, X.with_ctes("file_names") + f"""
    SELECT doc_id, file_name AS original, {_NEW} AS new_name, file_name <> {_NEW} AS renamed,
           '{DEST}/' || {_NEW} AS destination FROM file_names""")
register("clean_text", q_clean_text, f"SELECT doc_id, {T.clean_text_sql('text')} AS content FROM documents")
register("language_config", q_language_config,
         f"SELECT doc_id, lang, {T.language_config_sql('lang')} AS config FROM documents")
register("normalize_text", q_normalize_text,
         f"SELECT conv_id, turn, {T.normalize_sql('text')} AS normalized FROM conversations")
_SNIP = T.clean_snippet_sql(f"left(content, {C.CHUNK_SIZE})")
register("clean_snippet", q_clean_snippet, X.with_ctes("chunks") + f"SELECT chunk_id, {_SNIP} AS snippet FROM chunks")
register("double_url_encode", q_double_url_encode, X.with_ctes("chunks") + f"""
    SELECT chunk_id, {T.double_url_encode_sql(_SNIP)} AS highlight, {T.url_quote_sql('source', True)} AS file
    FROM chunks""")
_BL = T.is_blank_sql("text")
register("query_guard", q_query_guard, f"""
    SELECT conv_id, turn, {_BL} AS blank, CASE WHEN {_BL} THEN '{C.EMPTY_QUERY_REPLY}' END AS reply
    FROM conversations WHERE role = 'user'""")
register("unaccent", q_unaccent, f"SELECT doc_id, {T.unaccent_sql('text')} AS folded FROM documents")
register("text_vector", q_text_vector, X.with_ctes("chunks") + stopwords.config_postings_sql("chunks"))
register("already_loaded", q_already_loaded, ctes("batch", "loaded_table") + """
    SELECT b.doc_id, b.file_name, b.hash_value IN (SELECT hash_value FROM loaded_table) AS loaded FROM batch b""")
register("new_files_only", q_new_files_only, ctes("batch", "loaded_table") + """
    SELECT hash_value, min(file_name) AS file_name FROM batch
    WHERE hash_value NOT IN (SELECT hash_value FROM loaded_table) GROUP BY hash_value""")
register("ingest_report", q_ingest_report, ctes("batch", "loaded_table") + """
    SELECT CASE WHEN hash_value IN (SELECT hash_value FROM loaded_table) THEN 'rejected' ELSE 'processed' END AS status,
           count(*) AS n_files FROM batch GROUP BY 1""")


# ------------------------------------------------------------------ B10: language detection

def q_language_detect(spark, sf):
    model = sizing.materialize(langdetect.train(read_table(spark, sf, "documents", spread_key="doc_id")))
    conv = read_table(spark, sf, "conversations", spread_key="conv_id")
    return langdetect.with_config(langdetect.detect(conv, model, ["conv_id", "turn"]))


register("language_detect", q_language_detect,
         X.with_ctes("best", extra=detect_ctes("conversations", ("conv_id", "turn"), "text")) + f"""
    SELECT c.conv_id, c.turn, b.lang, {T.language_config_sql('b.lang')} AS config
    FROM conversations c LEFT JOIN best b ON b.conv_id = c.conv_id AND b.turn = c.turn""")


# ------------------------------------------------------------------ E7: incremental ingest (rows-only check)

def q_incremental_ingest(spark, sf):
    from ragloom.streaming.ingest_stream import run_twice

    table = run_twice(spark, sf, "documents.parquet")
    return table.groupBy("source").agg(F.count(F.lit(1)).alias("n_chunks"),
                                       F.countDistinct("page_number").alias("n_pages"))


def _ingest_sql():
    from ragloom.plans.chunks import recursive_chunks_sql

    return f"""
    SELECT source || '.pdf' AS source, count(*) AS n_chunks, count(DISTINCT page_number) AS n_pages
    FROM ({recursive_chunks_sql()}) GROUP BY source"""


register("incremental_ingest", q_incremental_ingest, _ingest_sql())
