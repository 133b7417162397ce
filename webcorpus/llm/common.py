"""Helpers shared by the operators: column picking, staged tables, exact ranks and thresholds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows that one Arrow batch carries to Python; very long texts stay bounded with it.
ARROW_ROWS = 512
#: Whether a query's shuffle files go when it ends, not when the driver's memory is cleared.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def tuned(spark: SparkSession) -> SparkSession:
    """Small Arrow batches, so that a batch of very long texts fits into a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one only for local sessions without the setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="webcorpus-llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: lineage ends there.

    Values that depend on task order (ids by partition) are frozen by this, so a
    lost executor cannot change them. The files go when the session ends, shuffle
    files as soon as the table is written.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return spark.read.schema(df.schema).parquet(path)


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns only, found by position, so that other columns may clash in any way."""
    columns = df.columns
    at = [columns.index(name) for name in names]
    return df.toDF(*[f"_{i}" for i in range(len(columns))]).select(
        *[F.col(f"_{i}").alias(name) for i, name in zip(at, names)]
    )


def numbered(df: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """All columns under positional names ``_in0...`` and the named ones also under their names."""
    columns = df.columns
    out = df.toDF(*[f"_in{i}" for i in range(len(columns))])
    return out.select("*", *[F.col(f"_in{columns.index(n)}").alias(n) for n in names]), columns


def restored(df: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """Undo ``numbered``: the original columns in order, some of them replaced."""
    return df.select(
        *[changed.get(name, F.col(f"_in{i}")).alias(f"_in{i}") for i, name in enumerate(columns)]
    ).toDF(*columns)


def row_key(*names: str) -> list[Column]:
    """128 bits that identify a row by content: two independent 64-bit hashes."""
    return [
        F.xxhash64(*names).alias("_k1"),
        F.xxhash64(F.lit(7919), *reversed(names)).alias("_k2"),
    ]


def gapless(df: DataFrame, keys: list[str], out: str) -> DataFrame:
    """Number the rows of every key from 0 without gaps, however large a key is.

    ``df`` must hold ``_uid``, a staged monotonically_increasing_id. A key is cut
    into blocks of the partitions that wrote it; rows are numbered within (key,
    block) and blocks get the row counts before them as offsets.
    """
    blocks = df.withColumn("_block", F.shiftright("_uid", 14))
    counts = blocks.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_block").orderBy("_uid")
    return (
        blocks.withColumn("_rn", F.row_number().over(inside) - 1)
        .join(offsets, [*keys, "_block"])
        .withColumn(out, (F.col("_before") + F.col("_rn")).cast("long"))
        .drop("_block", "_rn", "_before")
    )


def kth_largest(df: DataFrame, column: str, k: int) -> float | None:
    """Exact k-th largest value of a finite double column by narrowing histograms.

    Each step counts 4,096 equal bins over the remaining range with map-side
    sums, so the driver sees 4,096 numbers whatever the table holds.
    """
    values = df.select(F.col(column).alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    low, high, n = values.agg(F.min("v"), F.max("v"), F.count("v")).first()
    if not n or k < 1:
        return None
    if k >= n:
        return low
    bins = 4096
    while low < high:
        width = (high - low) / bins
        if width == 0 or low + width == low:
            break
        at = F.least(F.floor((F.col("v") - F.lit(low)) / F.lit(width)), F.lit(bins - 1))
        inside = values.where((F.col("v") >= low) & (F.col("v") <= high))
        found = inside.groupBy(at.alias("b")).agg(F.count("v"), F.min("v"), F.max("v")).collect()
        for _, count, least, most in sorted(found, key=lambda r: -r[0]):
            if k <= count:
                if (least, most) == (low, high):
                    return _by_sort(inside, k)
                low, high = least, most
                break
            k -= count
        else:
            raise AssertionError("the rank lies outside the counted range")
    return low if low == high else _by_sort(values.where((F.col("v") >= low) & (F.col("v") <= high)), k)


def _by_sort(values: DataFrame, k: int) -> float:
    """The k-th largest among the distinct values of an interval too narrow to cut further."""
    for value, count in sorted(((r[0], r[1]) for r in values.groupBy("v").count().collect()), reverse=True):
        if k <= count:
            return value
        k -= count
    raise AssertionError("fewer values than k")
