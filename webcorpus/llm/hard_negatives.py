"""Hard negatives over rotated one-bit codes with an interval that holds for certain.

A vector of whole numbers is made a unit vector, rotated by one random orthogonal
matrix and kept as ``LEVELS`` one-bit codes: the signs of its coordinates, then
the signs of what these leave, and so on, each with its alignment (the inner
product of what was left with the unit code) and at the end the length of what
none of them holds. An anchor is rotated likewise and rounded to ``BITS`` bit
planes, so that its inner product with a code is a sum of popcounts. By Cauchy
and Schwarz, the estimate is off by at most the anchor's rounding times the
length that the codes hold, and the length they do not hold. Vectors whose
interval cannot reach an anchor's list are left out; the others are scored in
whole numbers. No answer depends on chance.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webcorpus.llm.common import pick, shared_folder, stage, tuned

#: One-bit codes of a vector, and bit planes of an anchor.
LEVELS, BITS = 4, 7
#: Anchors that one pass over the codes answers; they travel with the job, and their results are written before the next pass.
ANCHOR_BLOCK = 4_096
#: Vectors and anchors whose intervals a task holds at once, and pairs it scores at once.
ROWS, COLUMNS, PAIRS = 1_024, 512, 1 << 16
_SEED = 70_657
#: Relative room for rounding in the float64 sums of an interval.
_ROUNDING = 1e-9
_LONG = (-(1 << 63), (1 << 63) - 1)


@cache
def rotation(dim: int) -> np.ndarray:
    """A random orthogonal matrix, the same everywhere."""
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64(_SEED + dim)).standard_normal((dim, dim)))
    return q * np.where(np.diag(r) < 0, -1.0, 1.0)


def whole_numbers(vector: np.ndarray, scale: int) -> list[int]:
    """``floor(scale * x)`` of every component, for components of any size."""
    return [int(x) * scale if abs(x) >= 1 << 53 else math.floor(x * scale) for x in vector.tolist()]


class Vectors:
    """Rows of an Arrow batch: whole numbers, and which rows need more than 64 bits in a product."""

    def __init__(self, lists: pa.Array, dim: int, scale: int) -> None:
        self.raw, self.scale = np.asarray(lists.flatten(), np.float64).reshape(-1, dim), scale
        with np.errstate(over="ignore"):
            scaled = np.floor(self.raw * scale)
        self.wide = (np.abs(scaled) > math.isqrt((1 << 62) // dim)).any(axis=1)
        scaled[self.wide] = 0
        self.whole = scaled.astype(np.int64)

    def exact(self, i: int) -> list[int]:
        return whole_numbers(self.raw[i], self.scale)


def scores(rows: Vectors, at: np.ndarray, anchors: Vectors, of: np.ndarray) -> np.ndarray:
    """Inner products of the pairs ``(at[i], of[i])``; those beyond 64 bits become the nearest long."""
    out = np.empty(len(at), np.int64)
    for i in range(0, len(at), PAIRS):
        part = slice(i, i + PAIRS)
        out[part] = (rows.whole[at[part]] * anchors.whole[of[part]]).sum(axis=1)
    for i in np.flatnonzero(rows.wide[at] | anchors.wide[of]):
        product = sum(x * y for x, y in zip(rows.exact(at[i]), anchors.exact(of[i])))
        out[i] = min(max(product, _LONG[0]), _LONG[1])
    return out


def _unit(vectors: Vectors) -> tuple[np.ndarray, np.ndarray]:
    """Lengths, and rotated unit vectors; wide vectors have an infinite length and a zero vector."""
    norm = np.sqrt((vectors.whole.astype(np.float64) ** 2).sum(axis=1))
    turned = vectors.whole / np.where(norm > 0, norm, 1.0)[:, None] @ rotation(vectors.raw.shape[1]).T
    return np.where(vectors.wide, np.inf, norm), turned


def _words(bits: np.ndarray) -> np.ndarray:
    """Rows of 64-bit words from rows of bits."""
    packed = np.packbits(bits, axis=1)
    padded = np.zeros((len(bits), -(-packed.shape[1] // 8) * 8), np.uint8)
    padded[:, : packed.shape[1]] = packed
    return padded.view(np.uint64)


def encode(vectors: Vectors) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """For each level the code's words and, side by side, the alignments; the length the codes leave; the vector's length."""
    norm, left = _unit(vectors)
    dim, codes, aligned = left.shape[1], [], []
    for _ in range(LEVELS):
        signs = left >= 0
        along = np.abs(left).sum(axis=1) / math.sqrt(dim)
        left = left - np.where(signs, 1.0, -1.0) * (along / math.sqrt(dim))[:, None]
        codes.append(_words(signs))
        aligned.append(along)
    return codes, np.stack(aligned, axis=1), np.sqrt((left**2).sum(axis=1)), norm


class Anchors:
    """A block of anchors with their bit planes."""

    def __init__(self, ids: list[int], labels: list[int], vectors: list[list[float]], scale: int) -> None:
        self.ids, self.labels = np.array(ids, np.int64), np.array(labels, np.int64)
        self.dim = len(vectors[0])
        self.vectors = Vectors(pa.array(vectors, pa.list_(pa.float64())), self.dim, scale)
        self.norm, turned = _unit(self.vectors)
        half = 1 << (BITS - 1)
        self.step = np.maximum(np.abs(turned).max(axis=1), 1e-300) / (half - 1)
        rounded = np.rint(turned / self.step[:, None]).astype(np.int64)
        self.off = np.sqrt(((turned - rounded * self.step[:, None]) ** 2).sum(axis=1))
        self.sum = (rounded + half).sum(axis=1)
        self.planes = [_words((rounded + half) >> j & 1) for j in range(BITS)]

    def intervals(self, codes: list[np.ndarray], aligned: np.ndarray, left: np.ndarray, norm: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest possible inner product of every row with the anchors ``cols``."""
        half, estimate = 1 << (BITS - 1), 0.0
        for level, code in enumerate(codes):
            ones = np.bitwise_count(code).sum(axis=1, dtype=np.int32)
            counted = np.zeros((len(code), len(cols)), np.int32)
            for j, plane in enumerate(self.planes):
                for word in range(code.shape[1]):
                    counted += np.bitwise_count(code[:, word, None] & plane[cols, word]).astype(np.int32) << j
            signed = 2 * counted - self.sum[cols] - (half * (2 * ones - self.dim))[:, None]
            estimate = estimate + signed * aligned[:, level, None]
        estimate = estimate * (self.step[cols] / math.sqrt(self.dim))
        held = 1 + left
        error = held[:, None] * self.off[cols] + left[:, None] + _ROUNDING
        with np.errstate(invalid="ignore"):
            length = norm[:, None] * self.norm[cols]
            low, high = (estimate - error) * length, (estimate + error) * length
        unknown = np.isinf(norm)[:, None] | np.isinf(self.norm[cols])
        return np.where(unknown, -np.inf, low), np.where(unknown, np.inf, high)


def build_codes(vectors: DataFrame, dim: int, scale: int) -> DataFrame:
    """Rows (vec_id, label, embedding, codes, aligned, rest, length) of vectors of ``dim`` components, written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes, aligned, left, norm = encode(Vectors(batch.column(2), dim, scale))
                packed = np.concatenate(codes, axis=1)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array([c.tobytes() for c in packed], pa.binary()), pa.array(list(aligned), pa.list_(pa.float64())), pa.array(left), pa.array(norm)],
                    ["vec_id", "label", "embedding", "codes", "aligned", "rest", "length"],
                )

    kinds = "vec_id long, label long, embedding array<double>, codes binary, aligned array<double>, rest double, length double"
    return stage(vectors.mapInArrow(run, kinds))


def _chunks(batches: Iterator[pa.RecordBatch], anchors: Anchors, scale: int) -> Iterator[tuple]:
    """Ids, labels, vectors and codes of at most ``ROWS`` rows at a time."""
    for whole in batches:
        for i in range(0, whole.num_rows, ROWS):
            batch = whole.slice(i, ROWS)
            n = batch.num_rows
            words = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint64).reshape(n, LEVELS, -1)
            aligned = np.asarray(batch.column("aligned").flatten(), np.float64).reshape(n, LEVELS)
            code = ([words[:, k] for k in range(LEVELS)], aligned, batch.column("rest").to_numpy(), batch.column("length").to_numpy())
            yield batch.column("vec_id").to_numpy(), batch.column("label").to_numpy(), Vectors(batch.column("embedding"), anchors.dim, scale), code


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, ~score))[:k]  # ~score falls as score rises and cannot overflow
    return score[order], ids[order]


class _Lists:
    """For each of ``n`` lists the k best (score, id) so far."""

    def __init__(self, n: int, k: int) -> None:
        self.k = k
        self.kept = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * n
        self.reach = np.full(n, -np.inf)

    def add(self, i: int, score: np.ndarray, ids: np.ndarray) -> None:
        now = self.kept[i] = _best(np.concatenate([self.kept[i][0], score]), np.concatenate([self.kept[i][1], ids]), self.k)
        if len(now[0]) == self.k:
            self.reach[i] = now[0][-1]

    def batch(self) -> pa.RecordBatch:
        counts = [len(s) for s, _ in self.kept]
        flat = [np.concatenate([x[j] for x in self.kept]) if self.kept else np.zeros(0, np.int64) for j in (0, 1)]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(len(counts), dtype=np.int32), counts)), pa.array(flat[1]), pa.array(flat[0])], ["q", "vec_id", "score"]
        )


def _runs(of: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Runs of equal values of a sorted array."""
    if len(of):
        cuts = np.flatnonzero(np.diff(of)) + 1
        for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(of)]):
            yield int(of[start]), slice(start, end)


def _positives(codes: DataFrame, anchors: Anchors, k: int, scale: int) -> DataFrame:
    """Rows (q, vec_id, score): for each task and anchor its k best other rows of the anchor's label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = _Lists(len(anchors.ids), k)
        by_label = {int(x): np.flatnonzero(anchors.labels == x) for x in np.unique(anchors.labels)}
        for ids, labels, vectors, code in _chunks(batches, anchors, scale):
            for label in np.unique(labels).tolist():
                at = np.flatnonzero(labels == label)
                part = [c[at] for c in code[0]], *(c[at] for c in code[1:])
                all_cols = by_label.get(label, np.zeros(0, np.int64))
                for c in range(0, len(all_cols), COLUMNS):
                    cols = all_cols[c : c + COLUMNS]
                    high = anchors.intervals(*part, cols)[1]
                    of, row = np.nonzero(((high >= lists.reach[cols]) & (ids[at][:, None] != anchors.ids[cols])).T)
                    score = scores(vectors, at[row], anchors.vectors, cols[of])
                    for i, run_of in _runs(of):
                        lists.add(cols[i], score[run_of], ids[at[row[run_of]]])
        yield lists.batch()

    return codes.mapInArrow(run, "q int, vec_id long, score long")


def _negatives(codes: DataFrame, anchors: Anchors, windows: list[tuple[int, int, int]], k: int, scale: int) -> DataFrame:
    """Rows (q, vec_id, score): for each task and window (anchor, least, largest score) its k best rows of other labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = _Lists(len(windows), k)
        order = sorted(range(len(windows)), key=lambda w: windows[w][0])
        of_anchor = np.array([windows[w][0] for w in order], np.int64)
        least, largest = (np.array([windows[w][x] for w in order], np.int64) for x in (1, 2))
        order = np.array(order, np.int64)
        wanted = np.unique(of_anchor)
        for ids, labels, vectors, code in _chunks(batches, anchors, scale):
            for c in range(0, len(wanted), COLUMNS):
                cols = wanted[c : c + COLUMNS]
                low, high = anchors.intervals(*code, cols)
                other = labels[:, None] != anchors.labels[cols]
                mine = slice(*np.searchsorted(of_anchor, [cols[0], cols[-1] + 1]))
                col = np.searchsorted(cols, of_anchor[mine])
                reach = np.maximum(lists.reach[order[mine]], least[mine].astype(np.float64))
                of, row = [], []
                for i in range(0, len(col), COLUMNS):
                    part = slice(i, i + COLUMNS)
                    hopeful = other[:, col[part]] & (high[:, col[part]] >= reach[part]) & (low[:, col[part]] <= largest[mine][part].astype(np.float64))
                    w, r = np.nonzero(hopeful.T)
                    of.append(w + i)
                    row.append(r)
                of, row = np.concatenate(of), np.concatenate(row)
                score = scores(vectors, row, anchors.vectors, cols[col[of]])
                fits = (score >= least[mine][of]) & (score <= largest[mine][of])
                of, row, score = of[fits], row[fits], score[fits]
                for i, run_of in _runs(of):
                    lists.add(order[mine][i], score[run_of], ids[row[run_of]])
        yield lists.batch()

    return codes.mapInArrow(run, "q int, vec_id long, score long")


def _top(found: DataFrame, k: int) -> DataFrame:
    """The k best of each q over all tasks; Spark keeps k rows of a task before it shuffles."""
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def usable(embedding: Column) -> Column:
    """Not null, not empty, no null or non-finite component."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return embedding.isNotNull() & (F.size(embedding) > 0) & ~F.coalesce(bad, F.lit(True))


def mine_hard_negatives(
    vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256
) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Both tables hold vec_id, label and embedding. A row's score is the inner
    product of the whole numbers floor(scale * x) of its components with the
    anchor's; higher scores come first, ties by smaller vec_id. An anchor's
    positives are its first rows of the same label and another vec_id; for each, the
    first rows of other labels with a score of ``low`` to ``high`` percent of the
    positive's are returned (fewer, if there are fewer). Zero vectors score 0.
    Rows with a null vec_id, label, vector or component, with a non-finite
    component, an empty vector or one of another length than most take no part.
    Repeated rows count each, repeated anchors once. Scores beyond 64 bits become
    the nearest long. Empty tables give no rows; other columns are ignored.
    """
    spark = tuned(vectors.sparkSession)
    whole = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("embedding"))

    def rows(table: DataFrame) -> DataFrame:
        kinds = [F.col(n).cast(t).alias(n) for n, t in (("vec_id", "long"), ("label", "long"), ("embedding", "array<double>"))]
        return pick(table, "vec_id", "label", "embedding").select(*kinds).where(whole)

    usual = sorted((-r[1], r[0]) for r in rows(vectors).groupBy(F.size("embedding")).count().collect())
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not usual:
        return spark.createDataFrame([], result)
    of_length = F.size("embedding") == usual[0][1]
    codes = build_codes(rows(vectors).where(of_length), usual[0][1], scale)
    asked = stage(rows(anchors).where(of_length).dropDuplicates(["vec_id", "label", "embedding"]))
    blocks = -(-asked.count() // ANCHOR_BLOCK)
    path = f"{shared_folder(spark)}/hard-negatives-{uuid.uuid4().hex}"
    spark.createDataFrame([], result).write.parquet(path)
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    for i in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(blocks)) == i).orderBy("vec_id").collect()
        if block:
            _mined(codes, Anchors(*map(list, zip(*block)), scale), positives, negatives, low, high, scale).write.mode("append").parquet(path)
    return spark.read.schema(result).parquet(path)


def _mined(codes: DataFrame, anchors: Anchors, positives: int, negatives: int, low: int, high: int, scale: int) -> DataFrame:
    """The result for one block of anchors."""
    spark = codes.sparkSession
    pairs = _top(_positives(codes, anchors, positives, scale), positives).select("q", "vec_id", "score").collect()
    kept, windows = [], []
    for q, positive, score in pairs:
        if score >= 0:  # below 0 the window is empty
            kept.append((len(kept), int(anchors.ids[q]), positive, score))
            windows.append((q, -(-low * score // 100), high * score // 100))
    found = _top(_negatives(codes, anchors, windows, negatives, scale), negatives)
    of = spark.createDataFrame(kept, "q int, anchor_id long, positive_id long, positive_score long")
    return found.join(F.broadcast(of), "q").select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
