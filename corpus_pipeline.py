"""From raw documents to packed sequences: five stages, each one operator of ``tidemark.llm``.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
reread as the next one's docs. All but the last return the columns of their input. A document
that a stage rejects goes: it is rejected by its id, so rows that share an id go together; rows
without an id are never rejected. Empty tables pass through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import exact, neardup, packing, quality, toxicity
from tidemark.llm.registry import CAPACITY, fit_toxicity
from tidemark.llm.support import new_folder
from tidemark.session import table


def without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """``docs`` but for the documents whose ids are in ``rejected``."""
    return docs.join(rejected.select(F.col("doc_id").alias("__out")), F.col("doc_id") == F.col("__out"), "left_anti")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = quality.judge(quality.count_texts(docs))
    return without(docs, judged.where(~F.col("kept")))


def clean_speech(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = toxicity.score(docs, fit_toxicity(spark, docs, sf_dir))
    return without(docs, scored.where("score >= 0.5"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with the same text the one with the largest id stays. Rows that repeat an id and its text are one
    document, and stay as they are: to thin them would shuffle all texts once more, for what no corpus should hold."""
    return without(docs, exact.exact_duplicates(docs, keep="max").where("not kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8; op5_near_dedup has terms of its own."""
    return without(docs, neardup.near_duplicates(docs, n=5, percent=80).where("not kept"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = packing.cut_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, capacity=CAPACITY)
    return packing.pack(pieces, CAPACITY, order=("doc_id", "piece"))


STAGES = [("quality rules", quality_rules), ("toxicity", clean_speech), ("exact dedup", exact_dedup), ("near dedup", near_dedup), ("packing", pack)]

#: The label model, the random field, signatures and tokenizers have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        folder = new_folder(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
