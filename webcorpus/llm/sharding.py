"""Rendezvous hashing of stable record keys over weighted shards.

Native: only DataFrame functions. Every (key, shard) pair has a hash; the shard
with the best weighted score wins. A new shard changes only the records that it
wins itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webcorpus.llm.common import gapless, pick, stage


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Number of the winning shard for a key.

    The score of shard i is ``-ln(u) / weight`` with u in (0, 1] from the hash of
    (key, i); the smallest score wins, ties go to the smaller shard. Shards of
    weight 0 get nothing. A null key is a key like any other.
    """
    if not any(w > 0 for w in weights) or any(w < 0 for w in weights):
        raise ValueError("weights must not be negative and one must be positive")

    def score(i: int, weight: float) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(i)), 11) + F.lit(1.0)) / F.lit(2.0**53)
        return F.struct((-F.log(u) / F.lit(float(weight))).alias("score"), F.lit(i).alias("shard"))

    scores = [score(i, w) for i, w in enumerate(weights) if w > 0]
    best = F.least(*scores) if len(scores) > 1 else scores[0]
    return best["shard"]


def shard_records(docs: DataFrame, weights: Sequence[float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Put every record into a shard: key, size, text_crc32, shard, slot, grown_shard.

    ``size`` is the UTF-8 length of the text plus 1 (1 for null), ``text_crc32``
    its CRC-32 (null for null), ``slot`` a gapless number within the shard and
    ``grown_shard`` the shard after one more of mean weight is added. Repeated
    rows share the shard and get slots of their own; other columns are ignored;
    an empty table gives an empty result.
    """
    weights = [float(w) for w in weights]
    grown = [*weights, sum(weights) / len(weights)]
    records = pick(docs, key, text).select(
        F.col(key),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.col(text).cast("binary")).alias("text_crc32"),
    )
    placed = stage(
        records.withColumn("shard", rendezvous(F.col(key), weights))
        .withColumn("grown_shard", rendezvous(F.col(key), grown))
        .withColumn("_uid", F.monotonically_increasing_id())
    )
    return gapless(placed, ["shard"], "slot").drop("_uid")
