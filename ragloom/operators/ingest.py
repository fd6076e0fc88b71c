"""Chunk tables: schema, row building, reset/append writes, load-once checks.

A chunk table is parquet partitioned by ``strategy`` (one table instead of one per
splitter). Files are identified by the SHA-256 of their cleaned name; a batch is
filtered by an anti-join on that key, so a file is never loaded twice.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as TY

from ragloom import constants as C
from ragloom.functions import text as T
from ragloom.functions import vectors as V

CODEC = "zstd"  # texts take about a quarter less than with the default

CHUNK_SCHEMA = TY.StructType([
    TY.StructField("chunk_id", TY.LongType(), False),
    TY.StructField("content", TY.StringType(), True),
    TY.StructField("embedding", TY.ArrayType(TY.FloatType()), True),
    TY.StructField("source", TY.StringType(), True),
    TY.StructField("page_number", TY.LongType(), True),
    TY.StructField("language", TY.StringType(), True),
    TY.StructField("hash_value", TY.StringType(), True),
    TY.StructField("strategy", TY.StringType(), True),
])

CLUSTERED_SCHEMA = TY.StructType(CHUNK_SCHEMA.fields + [
    TY.StructField("cluster_id", TY.StringType(), True),
    TY.StructField("cluster_embedding", TY.ArrayType(TY.FloatType()), True),
    TY.StructField("combined_embedding", TY.ArrayType(TY.FloatType()), True),
])


def create_table(spark: SparkSession, path: str, clustered: bool = False) -> None:
    """An empty chunk table at ``path``; a table that is already there stays as it is."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(fs_path):
        schema = CLUSTERED_SCHEMA if clustered else CHUNK_SCHEMA
        spark.createDataFrame([], schema).write.partitionBy("strategy").parquet(path)


def chunk_rows(chunks: DataFrame, strategy: str, language_col: str = "language") -> DataFrame:
    """A8 + B5-B7 + B9: the row stored per chunk.

    Content is cleaned (NUL removed, newline/tab to space), the source is the cleaned
    file name with NUL removed, the hash is that of the cleaned name, and the language
    column holds the text search configuration of the detected language.
    """
    src = F.translate(F.col("source").cast("string"), "\x00", "")
    return chunks.select(
        F.col("chunk_id").cast("long").alias("chunk_id"),
        T.clean_text(F.col("content").cast("string")).alias("content"),
        F.col("embedding").cast("array<float>").alias("embedding"),
        T.clean_filename(src).alias("source"),
        F.coalesce(F.col("page_number").cast("long"), F.lit(0).cast("long")).alias("page_number"),
        T.language_config(F.col(language_col)).alias("language"),
        T.file_hash(src).alias("hash_value"),
        F.lit(strategy).alias("strategy"),
    )


def write_chunks(rows: DataFrame, path: str, reset: bool, strategy: str | None = None) -> None:
    """``reset`` replaces rows (option 'Y'); otherwise rows are appended ('N').

    With ``strategy`` exactly that strategy's rows are replaced, also by none where ``rows`` has none of it;
    without it, those of the strategies that ``rows`` holds. No other strategy is touched."""
    if strategy is not None:
        if not re.fullmatch(r"[\w.-]+", strategy):
            raise ValueError("a strategy's name has letters, digits, points, hyphens and underscores only")
        rows = rows.where(F.col("strategy") == strategy)
        # the partition's folder itself: an empty write empties it too, and rows needn't be sorted by their one partition
        rows = rows.drop("strategy").write.mode("overwrite" if reset else "append").option("compression", CODEC)
        rows.parquet(f"{path}/strategy={strategy}")
        return
    w = rows.write.partitionBy("strategy").mode("overwrite" if reset else "append").option("compression", CODEC)
    (w.option("partitionOverwriteMode", "dynamic") if reset else w).parquet(path)


def file_keys(files: DataFrame, name_col: str = "file_name") -> DataFrame:
    return files.withColumn("hash_value", T.file_hash(F.col(name_col)))


def _of(table: DataFrame, strategy: str | None) -> DataFrame:
    return table if strategy is None else table.where(F.col("strategy") == strategy)


def already_loaded(files: DataFrame, table: DataFrame, name_col: str = "file_name", strategy: str | None = None) -> DataFrame:
    """Every file of the batch with ``loaded`` = its cleaned-name hash is in the table, under
    ``strategy`` if one is given (its partition alone is read)."""
    keys = _of(table, strategy).select("hash_value").distinct().withColumn("loaded", F.lit(True))
    return file_keys(files, name_col).join(keys, "hash_value", "left").select(
        *files.columns, "hash_value", F.coalesce("loaded", F.lit(False)).alias("loaded"))


def new_files_only(files: DataFrame, table: DataFrame, name_col: str = "file_name", strategy: str | None = None) -> DataFrame:
    """Files of the batch whose hash is not in the table (under ``strategy``, if given), one per hash
    (the smallest name when several names clean to the same text)."""
    fresh = file_keys(files, name_col).join(_of(table, strategy).select("hash_value"), "hash_value", "left_anti")
    return fresh.groupBy("hash_value").agg(F.min(name_col).alias(name_col))


def ingest_report(files: DataFrame, table: DataFrame, name_col: str = "file_name", strategy: str | None = None) -> DataFrame:
    """Processed, rejected and failed files of a batch: ``(status, n_files)``; the names by
    status are the rows of ``file_status``."""
    return file_status(files, table, name_col, strategy=strategy).groupBy("status").agg(F.count(F.lit(1)).alias("n_files"))


def file_status(files: DataFrame, table: DataFrame, name_col: str = "file_name", failed: DataFrame | None = None,
                strategy: str | None = None) -> DataFrame:
    """One row per file: its name and status, ``rejected`` (already in the table, under ``strategy`` if given), ``failed`` (its
    name is in ``failed``) or ``processed``."""
    flagged = already_loaded(files, table, name_col, strategy)
    bad = (failed.select(F.col(name_col)).distinct() if failed is not None else files.select(name_col).limit(0)).withColumn("_bad", F.lit(True))
    status = F.when(F.col("loaded"), "rejected").when(F.col("_bad"), "failed").otherwise("processed")
    return flagged.join(bad, name_col, "left").select(name_col, status.alias("status"))


def vectors_by_source(table: DataFrame, dim: int) -> DataFrame:
    """The ids and vectors of every source, rows without a vector left out; a vector of another
    width raises."""
    rows = table.where(F.col("embedding").isNotNull())
    return rows.select("source", "hash_value", "chunk_id", V.require_width("embedding", dim).alias("embedding"))


def write_clustered(rows: DataFrame, path: str, strategy: str) -> None:
    """Replace the strategy's rows of the clustered table at ``path`` by chunk rows with cluster_id,
    cluster_embedding and combined_embedding."""
    rows = rows.withColumn("strategy", F.lit(strategy))
    write_chunks(rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in CLUSTERED_SCHEMA.fields]), path, reset=True, strategy=strategy)


def embeddings_by_source(table: DataFrame, dim: int) -> DataFrame:
    """Per source the chunk count and hash; a vector of another width raises."""
    checked = table.select("source", "hash_value", V.require_width("embedding", dim).alias("embedding"))
    return checked.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_vectors"),
        F.min("hash_value").alias("hash_value"),
        F.sum(F.size("embedding")).alias("n_values"),
    )
