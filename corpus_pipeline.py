"""Corpus pipeline: quality, repeated lines, near duplicates, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir), with docs as its predecessor left them,
and is written as Parquet before the next one reads it. All but the last return
the columns of ``documents``; a filtering stage leaves out whole documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webcorpus.llm.common import stage
from webcorpus.llm.decontam import decontaminate
from webcorpus.llm.importance import select_quality
from webcorpus.llm.line_dedup import dedup_lines
from webcorpus.llm.near_dup import near_duplicates
from webcorpus.llm.packing import pack_documents

#: Words of a shingle and percent of similarity from which two documents are near duplicates.
SHINGLE_WORDS, SIMILARITY = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling draws; texts without words are not drawn."""
    return select_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated three-line windows; those without any text left go, null texts stay."""
    short = dedup_lines(docs)
    return short.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).where("text IS NULL OR n_chars > 0")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near duplicates."""
    groups = near_duplicates(docs, SHINGLE_WORDS, SIMILARITY)
    gone = groups.where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 4,096 tokens."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("lines", lines), ("near", near), ("leaks", leaks), ("packing", packing)]

#: Quality models, MinHash and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
