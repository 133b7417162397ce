"""Nearest neighbours by largest inner product over randomly rotated one-bit codes.

A vector is rotated by one random orthogonal matrix and kept as the signs of its
coordinates, its norm and the inner product of its direction with the code. For
a query, the packed bits give an unbiased estimate of the inner product, and a
bound on its error. A first pass over the codes finds for each query the k-th
best lower bound; a second one reranks, on the original vectors, exactly those
vectors whose upper bound reaches it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webcorpus.llm.common import pick, stage, tuned

#: Standard deviations of the estimate that a bound allows for.
EPSILON = 4.0
#: Queries that one pass answers; they travel to the tasks with the job. More queries take more passes.
QUERY_BLOCK = 4_096
#: Lists that one step of a merge takes together.
FAN_IN = 64
#: Vectors of which a task holds the estimates at once.
ROWS = 2_048
_SEED = 64_901


@cache
def rotation(dim: int) -> np.ndarray:
    """A random orthogonal matrix, the same everywhere."""
    gauss = np.random.Generator(np.random.PCG64(_SEED + dim)).standard_normal((dim, dim))
    q, r = np.linalg.qr(gauss)
    return q * np.sign(np.diag(r))


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(lists.flatten(), np.float64).reshape(-1, dim)


def _code(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs, norm, and inner product of the unit vector with its unit code."""
    norm = np.linalg.norm(vectors, axis=1)
    turned = vectors @ rotation(vectors.shape[1]).T
    aligned = np.abs(turned).sum(axis=1) / np.sqrt(vectors.shape[1]) / norm
    return np.packbits(turned >= 0, axis=1), norm, np.minimum(aligned, 1.0)


def usable(embedding: Column) -> Column:
    """Not null, no null or non-finite component, not zero."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return embedding.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(embedding, lambda x: x != 0)


def build_index(vectors: DataFrame, dim: int) -> DataFrame:
    """Rows (vec_id, embedding, code, norm, aligned) of all usable vectors of ``dim`` components, written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), dim)
            code, norm, aligned = _code(x) if len(x) else (np.zeros((0, 0), np.uint8), np.zeros(0), np.zeros(0))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(norm), pa.array(aligned)],
                ["vec_id", "embedding", "code", "norm", "aligned"],
            )

    return stage(vectors.mapInArrow(run, "vec_id long, embedding array<double>, code binary, norm double, aligned double"))


def _bounds(batch: pa.RecordBatch, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the inner products, one row for each query, from codes and scalars only."""
    dim = queries.shape[1]
    packed = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
    signs = np.unpackbits(packed, axis=1, count=dim).astype(np.float32) * 2 - 1
    norm, aligned = (batch.column(c).to_numpy() for c in ("norm", "aligned"))
    turned = (queries @ rotation(dim).T).astype(np.float32)
    estimate = (turned @ signs.T) / np.sqrt(dim) / aligned * norm
    spread = np.sqrt(np.maximum(1 - aligned**2, 0)) / aligned / np.sqrt(max(dim - 1, 1)) * norm
    error = EPSILON * np.linalg.norm(queries, axis=1)[:, None] * spread + 1e-6 * np.abs(estimate) + 1e-12
    return estimate - error, estimate + error


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            yield batch.slice(i, ROWS)


def _merged(best: DataFrame, k: int, partitions: int) -> DataFrame:
    """One list of the k smallest entries for each query from lists by (q, p): a tree of groups of at most ``FAN_IN`` lists."""
    while partitions > 1:
        partitions = -(-partitions // FAN_IN)
        group = F.floor(F.col("p") / FAN_IN).cast("int").alias("p")
        best = best.groupBy("q", group).agg(
            F.slice(F.sort_array(F.flatten(F.collect_list("best"))), 1, k).alias("best")
        )
    return best


def _search(index: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    """Rows (query_id, rank, vec_id, score) of the k nearest of each query of one block."""
    n = len(ids)
    numbers = pa.array(range(n), pa.int32())

    def part() -> pa.Array:
        return pa.array([TaskContext.get().partitionId()] * n, pa.int32())

    def lower(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((n, k), np.inf)
        for batch in _parts(batches):
            low = -_bounds(batch, queries)[0]
            low[ids[:, None] == batch.column("vec_id").to_numpy()] = np.inf
            best = np.partition(np.concatenate([best, low], axis=1), k - 1, axis=1)[:, :k]
        yield pa.RecordBatch.from_arrays([numbers, part(), pa.array(list(best), pa.list_(pa.float64()))], ["q", "p", "best"])

    codes = index.select("vec_id", "code", "norm", "aligned")
    first = stage(codes.mapInArrow(lower, "q int, p int, best array<double>"))
    partitions = (first.agg(F.max("p")).first()[0] or 0) + 1
    reach = np.full(n, -np.inf)
    for q, kth in _merged(first, k, partitions).select("q", F.element_at("best", -1)).collect():
        reach[q] = -kth

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0), np.zeros(0, np.int64))] * n
        for batch in _parts(batches):
            vec_id, x = batch.column("vec_id").to_numpy(), _matrix(batch.column("embedding"), queries.shape[1])
            hopeful = (_bounds(batch, queries)[1] >= reach[:, None]) & (ids[:, None] != vec_id)
            for q in np.flatnonzero(hopeful.any(axis=1)):
                rows = np.flatnonzero(hopeful[q])
                # row by row, so that equal vectors have equal scores wherever they stand
                score = np.concatenate([best[q][0], -(x[rows] * queries[q]).sum(axis=1)])
                found = np.concatenate([best[q][1], vec_id[rows]])
                order = np.lexsort((found, score))[:k]
                best[q] = score[order], found[order]
        pairs = [[{"s": s, "v": v} for s, v in zip(a.tolist(), b.tolist())] for a, b in best]
        kind = pa.list_(pa.struct([("s", pa.float64()), ("v", pa.int64())]))
        yield pa.RecordBatch.from_arrays([numbers, part(), pa.array(pairs, kind)], ["q", "p", "best"])

    second = index.mapInArrow(rerank, "q int, p int, best array<struct<s: double, v: bigint>>")
    nearest = _merged(stage(second), k, partitions).select("q", F.posexplode("best").alias("at", "found"))
    of = index.sparkSession.createDataFrame(list(enumerate(ids.tolist())), "q int, query_id long")
    return nearest.join(of, "q").select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("found.v").alias("vec_id"), (-F.col("found.s")).alias("score")
    )


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for each row of ``queries`` its k nearest rows of ``vectors``.

    Both tables hold vec_id and embedding; a query never finds rows of its own
    vec_id. Scores are inner products of the original vectors in double precision,
    largest first, ties to the smaller vec_id; with fewer than k candidates all
    are returned. Vectors that are null, zero, of another length than most, or
    hold null or non-finite components take no part; so do null ids. Repeated
    queries count once. Empty tables give no rows; other columns are ignored.
    """
    spark = tuned(vectors.sparkSession)
    kinds = (F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    usable_rows = usable(F.col("embedding")) & F.col("vec_id").isNotNull()
    rows = pick(vectors, "vec_id", "embedding").select(*kinds).where(usable_rows)
    lengths = sorted((-r[1], r[0]) for r in rows.groupBy(F.size("embedding")).count().collect())
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not lengths:
        return empty
    dim = lengths[0][1]
    of_length = F.size("embedding") == dim
    index = build_index(rows.where(of_length), dim)
    asked = stage(pick(queries, "vec_id", "embedding").select(*kinds).where(usable_rows & of_length).dropDuplicates(["vec_id", "embedding"]))
    blocks = -(-asked.count() // QUERY_BLOCK)
    out = empty
    for i in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i).orderBy("vec_id").collect()
        if block:
            ids = np.array([r[0] for r in block], np.int64)
            out = out.union(_search(index, ids, np.array([r[1] for r in block], np.float64), k))
    return out
