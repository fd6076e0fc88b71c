"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's ``docs``. All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.llm import decontaminate, packing, pii, simhash, toxicity
from ragloom.llm.common import read
from ragloom.session import scratch_path

CAPACITY = 2048


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity scorer rejects go. Nothing goes if nothing was learned (no labels, or none of one
    kind); null and empty texts have the scorer's bias alone, and repeated rows stay or go together."""
    return toxicity.drop_toxic(docs, read(spark, sf_dir, "labels"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the least doc_id; of repeated rows one. Texts without
    a word (null, empty) have the fingerprint zero and so are one group."""
    return simhash.deduplicate(docs, shingle=3, radius=2)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold too much of the benchmark go, repeated rows alike; null and empty texts have no words and stay,
    as all do where the benchmark is empty."""
    return decontaminate.remove_contaminated(docs, read(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced in the text; n_chars, where present, follows. Null and empty texts stay as they are,
    repeated rows are changed alike."""
    out = pii.redact(docs, pii.train(docs))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all remaining documents with their places in sequences of 2048 tokens. Null and empty texts are one
    piece, their end id; repeated rows have pieces of their own, in any order among equal sizes."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, capacity=CAPACITY)


STAGES = [("toxicity", drop_toxic), ("simhash_near_dedup", deduplicate), ("benchmark_decontamination", drop_contaminated),
          ("pii", redact_personal_data), ("best_fit_packing", pack)]
ORACLE_SQL = None  # tokens and trained models are beyond SQL; tests compare each stage's rows


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written in the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    folder = scratch_path(spark, f"pipeline/{uuid.uuid4().hex}")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
