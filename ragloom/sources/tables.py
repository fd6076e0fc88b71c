"""Sources: table readers, page tables, question/answer sets, file listings."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ragloom.functions import text as T

TABLES = ("documents", "embeddings", "benchmark", "labels", "conversations", "pages")


SPREAD_MAX_BYTES = 1 << 30


def read_table(spark: SparkSession, sf_dir: str, name: str, spread_key: str | None = None) -> DataFrame:
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return spread(df, spread_key) if spread_key else df


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-partition a small scan that arrives in fewer files than task slots.

    A single parquet file with one row group is read by one task, and every narrow
    per-row step after it (tokenising, splitting pages) would stay in that task.
    Large inputs come in many row groups and are read in parallel anyway, so they are
    left alone: the shuffle is only added when the scan is under 1 GiB.
    """
    spark = df.sparkSession
    slots = spark.sparkContext.defaultParallelism
    try:
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:  # noqa: BLE001 - no estimate: leave the scan as it is
        return df
    if size <= SPREAD_MAX_BYTES and len(df.inputFiles()) < slots:
        return df.repartition(slots, key)
    return df


def page_table(pages: DataFrame, text_col: str = "text", source_col: str = "source",
               order_col: str | None = None, page_mark: str | None = None) -> DataFrame:
    """A2 + A3: one row per non-blank page with a 1-based page number.

    Two input shapes:
    * one row per page (``order_col`` orders pages inside a source), or
    * one row per file whose text separates pages by ``page_mark`` (form feed).
    Numbering happens before blank pages are dropped, so blank pages leave gaps. Every row keeps its place:
    null sources are one document, null keys come first, equal keys follow the order of their texts' hash.
    """
    if page_mark is not None:
        exploded = pages.select(
            F.col(source_col).alias("source"),
            F.posexplode(F.split(F.col(text_col), page_mark, -1)).alias("pos", "text"),
        )
        numbered = exploded.select("source", (F.col("pos") + 1).cast("long").alias("page_number"), "text")
    else:
        from ragloom.operators.ranking import row_number_in_groups

        # the rows themselves are numbered, so null sources and keys stay and equal keys have a number each
        numbered = row_number_in_groups(pages.withColumn("_tie", F.xxhash64(text_col)), source_col, [order_col, "_tie"],
                                        out="page_number").drop("_tie")
        if source_col != "source":
            numbered = numbered.withColumnRenamed(source_col, "source")
        if text_col != "text":
            numbered = numbered.withColumnRenamed(text_col, "text")
    return numbered.where(~T.is_blank("text"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    """Whether the path, on whatever file system, is a folder; a missing one raises."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def list_files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """A1: files of one directory (not recursive) whose name matches ``pattern``
    (case-sensitive), or the single file named, whatever its name; a missing path raises. Bytes are read
    only if ``content`` is."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "false")
    if _is_folder(spark, path):
        reader = reader.option("pathGlobFilter", pattern)
    df = reader.load(path)
    return df.select(
        F.col("path"),
        F.element_at(F.split(F.col("path"), "/"), -1).alias("source"),
        F.col("length"),
        F.col("content"),
    )


def page_records(spark: SparkSession, path: str | list[str], pattern: str = "*.txt", page_mark: str = "\f", keep: tuple = ()) -> DataFrame:
    """A1 + A2: the pages of a folder's page files (texts with a ``page_mark`` between pages), or of the files in a list, one
    row each: file_path, file_name, block (where the part of the file that a task reads begins), text, and the
    partition columns in ``keep``. A page is a record of the file, so a large file is read by many tasks and no file is
    held as a whole. Files may be on any file system; a missing folder raises."""
    if isinstance(path, str):
        _is_folder(spark, path)
    else:
        path = [re.sub(r"([\[\]{}*?\\])", r"\\\1", p) for p in path]  # names, not patterns
    df = spark.read.option("lineSep", page_mark).option("pathGlobFilter", pattern).text(path)
    name = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))  # it comes encoded, but for +
    return df.select(F.col("_metadata.file_path").alias("file_path"), name.alias("file_name"),
                     F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("text"), *keep)


def number_pages(records: DataFrame) -> DataFrame:
    """``page_records`` with page_number, from 1 in each file, blank pages counted: records are numbered by block and
    their order in it, over all tasks that read a file. Files are read once: one task reads a block, record by record,
    so a record's place in its block is its distance from the block's first. ``records`` are as read, not exchanged;
    many small files are few tasks, each reads its files whole, one after another."""
    from ragloom.operators import sizing

    n = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = sizing.materialize(records.coalesce(n).withColumn("_place", F.monotonically_increasing_id()))
    blocks = placed.groupBy("file_path", "block").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("file_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file_path", "block", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    number = (F.col("_off") + F.col("_place") - F.col("_first") + 1).cast("long")
    return placed.join(blocks, ["file_path", "block"]).withColumn("page_number", number).select(
        *[c for c in placed.columns if c not in ("block", "_place")], "page_number")


def page_files(spark: SparkSession, path: str, pattern: str = "*.txt", page_mark: str = "\f", keep: tuple = ()) -> DataFrame:
    """A1-A3: non-blank pages of a folder's page files: file_path, file_name, page_number, text, and ``keep``. Blank pages
    leave gaps; an empty file has no page."""
    return number_pages(page_records(spark, path, pattern, page_mark, keep)).where(~T.is_blank("text"))


def load_qa(df: DataFrame, question_col: str = "QUERY", answer_col: str = "ANSWER") -> DataFrame:
    """A4: question/answer set with the two required columns."""
    if question_col not in df.columns or answer_col not in df.columns:
        raise ValueError(f"The file must contain the columns '{question_col}' and '{answer_col}'")
    return df.select(F.col(question_col).alias("question"), F.col(answer_col).alias("answer"))
