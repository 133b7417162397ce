"""Session settings and helpers that keep joins and loops safe at scale."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
#: Bytes of a table, as JSON text, up to which it is broadcast.
BROADCAST_BYTES = 32 << 20
SALTS = 32
#: Spark estimates tables that are made of pages (elements, page rows) at a fraction of their
#: size. Only shuffled sides, whose bytes were counted, are broadcast, not estimated ones.
MEASURED_JOINS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB",
}


def build_session(app: str = "webcorpus", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators are tuned for; ``conf`` overrides them."""
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # joins on (page_id, x) may reuse a partitioning on page_id
        "spark.sql.requireAllClusterKeysForCoPartition": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
        **MEASURED_JOINS,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Apply the settings that matter for the plans to a running session."""
    for key, value in MEASURED_JOINS.items():
        spark.conf.set(key, value)
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the folder the cluster names in spark.checkpoint.dir."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a shared folder")
            folder = tempfile.mkdtemp(prefix="webcorpus-checkpoint-")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder where all executors can read and write; it goes when the session ends."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="webcorpus-")
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def written(df: DataFrame, name: str = "written") -> DataFrame:
    """The same rows, written out once for several readers; each of them reads only the columns it needs."""
    path = scratch_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """True when the table has at most ``max_rows`` rows and ``BROADCAST_BYTES`` bytes; reads no more rows than that."""
    wide = F.length(F.to_json(F.struct("*")))
    rows, size = df.limit(max_rows + 1).agg(F.count("*"), F.coalesce(F.sum(wide), F.lit(0))).first()
    return rows <= max_rows and size <= BROADCAST_BYTES


def join_small(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    spread: str,
    how: str = "inner",
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join a large table with a table that is usually small.

    The small side is written out, so that measuring and joining it do not compute it
    twice, and broadcast when bounded rows and bytes prove it small: Spark's estimate
    may be far too low. Beyond that it is copied once per salt and the large side is
    spread over the salts by ``spread``, so one hot key is shared by ``SALTS`` tasks.
    """
    small = cut_lineage(small)
    if fits_broadcast(small, max_rows):
        return big.join(F.broadcast(small), on, how)
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    return salted.join(small.withColumn("_salt", salts), [*on, "_salt"], how).drop("_salt")
