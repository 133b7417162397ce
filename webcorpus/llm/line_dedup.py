"""Removal of repeated passages by overlapping windows of three lines.

Every run of three consecutive lines is hashed; a window that occurs more than
once anywhere keeps its first occurrence (by doc_id, then line), and the lines
that any later occurrence covers are removed. Each removed line equals a line
at an earlier place, so by going back one reaches a line that stays: no content
is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webcorpus.functions.text import let
from webcorpus.llm.common import numbered, restored, row_key, stage

WINDOW_LINES = 3


def _windows(text: Column, size: int) -> Column:
    """128-bit hashes of all windows in order; none for fewer lines than a window has.

    A line is hashed once; a window's hash is that of its lines' hashes.
    """
    halves = lambda line: F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(7919), line).alias("b"))

    def hashed(lines: Column) -> Column:
        last = F.size(lines) - size
        at = lambda i, half: [F.get(lines, i + k)[half] for k in range(size)]
        window = lambda i: F.struct(F.xxhash64(*at(i, "a")).alias("a"), F.xxhash64(*at(i, "b")).alias("b"))
        none = F.array().cast("array<struct<a: bigint, b: bigint>>")
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), window)).otherwise(none)

    return let(F.transform(F.split(text, "\n", -1), halves), hashed)


def repeated_lines(docs: DataFrame, size: int = WINDOW_LINES) -> DataFrame:
    """Rows (_k1, _k2, covered): 0-based numbers of the lines to remove of every text that loses some.

    Places and hashes of all windows are written once. Occurrences of a window are
    counted with map-side sums; the join back to the occurrences is an inner join
    of which Spark splits hot keys. Rows that agree in doc_id and text are one occurrence.
    """
    # keys are made before the windows are spread: afterwards they would be hashed again for every window
    keyed = docs.select("doc_id", *row_key("doc_id", "text"), _windows(F.col("text"), size).alias("_windows"))
    found = stage(keyed.select("doc_id", "_k1", "_k2", F.posexplode("_windows").alias("pos", "w")))
    place = F.struct("doc_id", "_k1", "_k2", "pos")
    firsts = found.groupBy("w").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first != last")
    later = found.join(firsts.select("w", "first"), "w").where(place != F.col("first"))
    return later.groupBy("_k1", "_k2").agg(F.collect_set("pos").alias("starts")).select(
        "_k1", "_k2",
        F.array_distinct(F.flatten(F.transform("starts", lambda p: F.sequence(p, p + size - 1)))).alias("covered"),
    )


def dedup_lines(docs: DataFrame, size: int = WINDOW_LINES) -> DataFrame:
    """``docs`` with a text without the lines that later occurrences cover; all columns stay.

    Null and empty texts and texts of fewer than ``size`` lines stay as they
    are. A text of which every line is covered becomes empty. Repeated rows (same
    doc_id and text) are one document and all keep its lines; a null doc_id comes
    before the others. Any further columns pass through.
    """
    inner, columns = numbered(docs, "doc_id", "text")
    covered = repeated_lines(inner.select("doc_id", "text"), size)
    keyed = inner.select("*", *row_key("doc_id", "text"))
    joined = keyed.join(covered, ["_k1", "_k2"], "left")
    # the split is bound once; inside the lambda it would be made again for every line
    kept = let(
        F.split("text", "\n", -1),
        lambda lines: F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("covered")), lambda i: F.get(lines, i)),
    )
    return restored(joined, columns, text=F.when(F.col("covered").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")))
