"""Registered queries of the operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webcorpus.llm.ann import nearest
from webcorpus.llm.conversation import damage, repair_report
from webcorpus.llm.decontam import leaks
from webcorpus.llm.hard_negatives import mine_hard_negatives
from webcorpus.llm.html_extract import extract_main_text
from webcorpus.llm.importance import score_quality
from webcorpus.llm.langid import dictionaries, identify
from webcorpus.llm.line_dedup import dedup_lines
from webcorpus.llm.near_dup import near_duplicates
from webcorpus.llm.packing import pack_documents
from webcorpus.llm.quality_rules import fit_lines, rate_documents
from webcorpus.llm.repair_sql import STRUCTURE_REPAIR
from webcorpus.llm.sharding import shard_records
from webcorpus.llm.tokencount import count_tokens


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best occurrence of each benchmark item in each document, within the error budget."""
    return leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 15 by doc_id."""
    placed = shard_records(_table(spark, sf_dir, "documents"), [1.0] * 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_main_text(_table(spark, sf_dir, "pages"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 2-word shingles have a similarity of 0.8 or more."""
    return near_duplicates(_table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth vector."""
    vectors = _table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of unigram pieces of every document."""
    return count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; learned from documents outside the held-out quarter."""
    docs = _table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    content = dictionaries(docs.where(~held_out).select("text", "lang"))
    found = identify(docs, content)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4,096 tokens."""
    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance weight, Gumbel key and choice of every document."""
    return score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that later occurrences of a three-line window cover."""
    return dedup_lines(_table(spark, sf_dir, "documents")).select("doc_id", "text")


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and digest of every conversation, damaged in a known way."""
    return repair_report(damage(_table(spark, sf_dir, "conversations")))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector; each seventh label is moved on first."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = _table(spark, sf_dir, "embeddings").withColumn("label", moved)
    return mine_hard_negatives(vectors, vectors.where("vec_id % 50 = 0"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document, and whether enough of its words stand in content lines."""
    docs = _table(spark, sf_dir, "documents")
    return rate_documents(docs, fit_lines(docs, _table(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_decontamination, op2_sharding, op3_html_extraction, op4_minhash, op5_nearest, op6_token_counts,
        op7_language, op8_packing, op9_quality, op10_line_dedup, op11_structure_repair,
        op12_hard_negatives, op13_quality_rules,
    )
}

ORACLES: dict[str, str] = {
    "op11_structure_repair": STRUCTURE_REPAIR,
    "op12_hard_negatives": """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_dot_product(a.v, r.v)::BIGINT AS score
  FROM rows a JOIN rows r ON a.vec_id % 50 = 0 AND a.vec_id <> r.vec_id),
positives AS (
  SELECT * FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id,
  row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id)::INT AS rank,
  n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scores n ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY rank <= 3""",
    "op10_line_dedup": """
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents WHERE text IS NOT NULL),
windows AS (
  SELECT doc_id, pos, line || chr(10) || lead(line) OVER d || chr(10) || lead(line, 2) OVER d AS w
  FROM lines WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
ranked AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) AS occurrence
  FROM windows WHERE w IS NOT NULL),
covered AS (
  SELECT DISTINCT doc_id, pos + unnest([0, 1, 2]) AS pos FROM ranked WHERE occurrence > 1),
kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text
  FROM lines ANTI JOIN covered USING (doc_id, pos) GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
FROM documents d LEFT JOIN kept k USING (doc_id)""",
}
