"""Quality by importance resampling: n-gram models of target and raw text, Gumbel top-k.

The raw text is the whole corpus; the target is the good part of three quarters
of a bounded sample of labelled documents. Log ratios of the two models, averaged
over a document's n-grams, are calibrated on the last quarter to log odds; these
are the log importance weights. As many documents are drawn without replacement
as have odds above even, by the largest sums of weight and Gumbel noise.

The models count every n-gram by a 64-bit hash and grow with the corpus. N-grams
that are frequent in a part of the corpus are counted by every task. The others are
shuffled once, as packed lists of the documents that hold them, to the task of their
hash range, which knows all their sightings and gives back what they add to documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webcorpus.llm.common import kth_largest, numbered, pick, row_key, stage, tuned
from webcorpus.llm.wordhash import TOKENS, flat, mix, shingle_hashes, slices, word_hashes

#: Frequent n-grams that go to every task, at 12 bytes each; the others are shuffled.
HOT_GRAMS = 1 << 16
#: One text in so many, drawn by hash, tells which n-grams are frequent. All counts are those of the whole corpus.
DRAWN = 128
#: N-grams of texts that a task packs at once, and that one hash range holds on average.
PACKED_GRAMS, RANGE_GRAMS = 1 << 22, 1 << 22
#: Shares of the hash ranges that are shuffled one after the other: what one leaves on disk goes before the next.
PASSES = 2
#: N-grams that a counting task holds before it merges them and hands them on.
HELD_GRAMS = 1 << 21
#: N-grams that a counting task hands on at once: a batch stands in Python's and in the JVM's memory.
BATCH_GRAMS = 1 << 16
#: The pair of any word with itself.
SELF_PAIR = np.int64(0x51ED270B7F4A7C15)
#: Labelled documents, drawn by the hash of their ids, that models and calibration see. Broadcast, so bounded.
SAMPLE = 60_000
#: Added to the seen and the expected count of an n-gram: few sightings say little.
SMOOTHING = 1.0
#: Log ratios become whole numbers of 1/SCALE, so that sums do not depend on their order.
SCALE = 1 << 16
#: Log ratio of an n-gram below which it counts as foreign to the target.
FOREIGN = -1.0
#: Scale of the Gumbel noise: 0 ranks by weight alone, 1 draws in proportion to the weights.
TEMPERATURE = 0.1

FEATURES = 5
#: Columns of counted n-grams.
ENTRY = ["h", "pair", "raw", "target"]
#: Documents of a chunk, with the sums of the n-grams that tasks hold and of all others as if seen once.
MEASURED = pa.schema(
    [("doc_id", pa.int64()), ("n", pa.list_(pa.int64())), ("sums", pa.list_(pa.int64())), ("good", pa.int32()),
     ("model", pa.bool_()), ("_k1", pa.int64()), ("_k2", pa.int64())]
)
MEASURED_DDL = "doc_id long, n array<long>, sums array<long>, good int, model boolean, _k1 long, _k2 long"
#: Documents (kind -1), words (0) or pairs (1) of a chunk: ``data`` packs ``a`` n-grams or documents, and ``b`` sightings.
PACKED = pa.schema([("part", pa.int64()), ("chunk", pa.int64()), ("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("data", pa.binary())])
PACKED_DDL = "part long, chunk long, kind int, a long, b long, data binary"


def ngrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of single words and of pairs, and where each text's words and pairs begin.

    A word after itself is one pair of its own, whatever the word.
    """
    words, at = word_hashes(*flat(texts), TOKENS)
    pairs = shingle_hashes(words, 2).view(np.int64)
    pairs[words[1:] == words[:-1]] = SELF_PAIR
    last = at[1:][(at[1:] > 0) & (at[1:] < len(words))] - 1  # pairs over two texts
    inside = np.ones(len(pairs), bool)
    inside[last] = False
    pair_at = np.concatenate([[0], np.cumsum(inside)])[np.minimum(at, len(pairs))]
    return words.view(np.int64), at, pairs[inside], pair_at


def _labelled(labels: DataFrame) -> DataFrame:
    """Rows (doc_id, good, model) of the sample.

    ``good``: quality 1 and not toxic; contradicting rows are not good. ``model``:
    whether the document is for the target model or for calibration.
    """
    rows = pick(labels, "doc_id", "quality", "toxic").where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL")
    good = F.min(((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int")).alias("good")
    one = rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(good)
    drawn = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    return drawn.withColumn("model", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4)) != 0)


def _merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """One entry (hash, raw, target) for each hash. Empties ``parts``, so that they are not held beside the joined arrays."""
    grams, raw, target = (np.concatenate(x) for x in zip(*parts))
    parts.clear()
    order = np.argsort(grams, kind="stable")  # parts are sorted, which makes this a merge
    grams = grams[order]
    first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    grams = grams[first]
    raw = np.add.reduceat(raw[order], first)
    return grams, raw, np.add.reduceat(target[order], first)


def _batches(pair: bool, grams: np.ndarray, raw: np.ndarray, target: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Entries of one kind as rows (h, pair, raw, target), a bounded number at once."""
    for i in range(0, len(grams), BATCH_GRAMS):
        h, n, good = (pa.array(x[i : i + BATCH_GRAMS]) for x in (grams, raw, target))
        yield pa.RecordBatch.from_arrays([h, pa.array(np.full(len(h), pair)), n, good], ENTRY)


def ratio_model(texts: DataFrame) -> tuple[DataFrame, tuple[int, int]]:
    """The model from rows (doc_id, text, good, model): rows (h, pair, raw, ratio), and the ratios of any other word and pair.

    ``ratio`` is the log ratio of target and raw model in whole numbers. N-grams
    that occur once, outside the target, all have the same one and are not listed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list] = ([], [])
        totals = np.zeros((2, 2), np.int64)
        for whole in batches:
            for batch in slices(whole, "text"):
                good = np.equal(batch.column(2).fill_null(0).to_numpy(zero_copy_only=False), 1)
                good &= batch.column(3).fill_null(False).to_numpy(zero_copy_only=False)
                single, at, pairs, pair_at = ngrams(batch.column(1))
                for pair, grams, begins in ((0, single, at), (1, pairs, pair_at)):
                    if not len(grams):
                        continue
                    target = np.repeat(good, np.diff(begins)).astype(np.int64)
                    totals[pair] += len(grams), target.sum()
                    held[pair].append(_merged([(grams, np.ones(len(grams), np.int64), target)]))
                    if sum(len(x[0]) for x in held[pair]) > HELD_GRAMS:
                        held[pair][:] = [_merged(held[pair])]
                        if len(held[pair][0][0]) > HELD_GRAMS // 2:
                            yield from _batches(pair == 1, *held[pair].pop())
        for pair in (0, 1):
            if held[pair]:
                yield from _batches(pair == 1, *_merged(held[pair]))
        yield pa.RecordBatch.from_arrays([pa.nulls(2, pa.int64()), pa.array([False, True]), pa.array(totals[:, 0]), pa.array(totals[:, 1])], ENTRY)

    counted = texts.mapInArrow(run, "h long, pair boolean, raw long, target long").groupBy("h", "pair").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    counted = stage(counted.where("h IS NULL OR raw > 1 OR target > 0"))
    shares = {r.pair: r.target / max(r.raw, 1) for r in counted.where("h IS NULL").collect()}
    share = F.when(F.col("pair"), shares.get(True, 0.0)).otherwise(shares.get(False, 0.0))
    ratio = F.rint(F.log((F.col("target") + SMOOTHING) / (F.col("raw") * share + SMOOTHING)) * SCALE).cast("int")
    once = tuple(round(math.log(SMOOTHING / (shares.get(pair, 0.0) + SMOOTHING)) * SCALE) for pair in (False, True))
    return counted.where("h IS NOT NULL").select("h", "pair", "raw", ratio.alias("ratio")), once


def _log_ratio(raw: np.ndarray, target: np.ndarray, share: float) -> np.ndarray:
    """Log ratios of counted n-grams in whole numbers."""
    return np.rint(np.log((target + SMOOTHING) / (raw * share + SMOOTHING)) * SCALE).astype(np.int64)


def _excess(ratio: np.ndarray) -> np.ndarray:
    return np.minimum(ratio - int(FOREIGN * SCALE), 0)


class Held:
    """Frequent n-grams that every task holds, sorted, of words and of pairs."""

    def __init__(self, grams: np.ndarray, pair: np.ndarray):
        self.grams = [np.sort(grams[~pair]), np.sort(grams[pair])]
        self.ratios: list[np.ndarray] = []
        self.shares: list[float] = []

    def find(self, kind: int, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each n-gram in the list, and whether it is there."""
        own = self.grams[kind]
        if not len(own):
            return np.zeros(len(grams), np.int64), np.zeros(len(grams), bool)
        at = np.minimum(np.searchsorted(own, grams), len(own) - 1)
        return at, own[at] == grams

    def once(self, kind: int) -> int:
        """Ratio of an n-gram that occurs once, outside the target."""
        return round(math.log(SMOOTHING / (self.shares[kind] + SMOOTHING)) * SCALE)


def _in_target(batch: pa.RecordBatch) -> np.ndarray:
    """Which rows (doc_id, text, good, model...) the target model is made of."""
    good = np.equal(batch.column(2).fill_null(0).to_numpy(zero_copy_only=False), 1)
    return good & batch.column(3).fill_null(False).to_numpy(zero_copy_only=False)


def held_model(texts: DataFrame, hot_grams: int) -> tuple[Held, int]:
    """The frequent n-grams with their ratios over all ``texts``, and the number of n-grams of all texts."""
    drawn = texts.where(F.pmod(F.xxhash64("text"), F.lit(DRAWN)) == 0)
    frequent = ratio_model(drawn)[0].orderBy(F.desc("raw"), "pair", "h").limit(hot_grams).select("h", "pair").toArrow()
    held = Held(frequent.column(0).to_numpy(), frequent.column(1).to_numpy())
    shared = texts.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = shared.value
        raw, target = ([np.zeros(len(g), np.int64) for g in mine.grams] for _ in "rt")
        totals = np.zeros((2, 2), np.int64)
        for whole in batches:
            for batch in slices(whole, "text"):
                good = _in_target(batch)
                single, at, pairs, pair_at = ngrams(batch.column(1))
                for kind, grams, begins in ((0, single, at), (1, pairs, pair_at)):
                    hit = np.repeat(good, np.diff(begins))
                    totals[kind] += len(grams), hit.sum()
                    spot, there = mine.find(kind, grams)
                    raw[kind] += np.bincount(spot[there], minlength=len(raw[kind]))
                    target[kind] += np.bincount(spot[there & hit], minlength=len(raw[kind]))
        for kind in (0, 1):
            seen = raw[kind] > 0
            yield from _batches(kind == 1, mine.grams[kind][seen], raw[kind][seen], target[kind][seen])
        yield pa.RecordBatch.from_arrays([pa.nulls(2, pa.int64()), pa.array([False, True]), pa.array(totals[:, 0]), pa.array(totals[:, 1])], ENTRY)

    counted = texts.mapInArrow(run, "h long, pair boolean, raw long, target long").groupBy("h", "pair").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    total, n = counted.filter(counted.column("h").is_null()).to_pylist(), 0
    for kind in (0, 1):
        raw, target = next(((r["raw"], r["target"]) for r in total if r["pair"] == (kind == 1)), (0, 0))
        n += raw
        held.shares.append(target / max(raw, 1))
        mine = counted.filter(pa.array(np.equal(counted.column("pair").to_numpy(), kind == 1) & counted.column("h").is_valid().to_numpy()))
        raw, target = np.zeros((2, len(held.grams[kind])), np.int64)
        spot = np.searchsorted(held.grams[kind], mine.column("h").to_numpy())
        raw[spot], target[spot] = mine.column("raw").to_numpy(), mine.column("target").to_numpy()
        held.ratios.append(_log_ratio(raw, target, held.shares[kind]))
    return held, n


def _packed(*arrays: np.ndarray) -> bytes:
    """Whole numbers, first bytes of all, then second ones: small ones and repeated ones take little."""
    planes = b"".join(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() for a in arrays)
    return pa.compress(planes, codec="zstd", asbytes=True)


def _unpacked(data: bytes, *kinds: tuple[type, int]) -> list[np.ndarray]:
    """The arrays of ``_packed`` from their types and lengths."""
    sizes = [np.dtype(t).itemsize for t, _ in kinds]
    raw = np.frombuffer(pa.decompress(data, sum(s * n for s, (_, n) in zip(sizes, kinds)), codec="zstd", asbytes=True), np.uint8)
    out, at = [], 0
    for size, (kind, n) in zip(sizes, kinds):
        out.append(np.ascontiguousarray(raw[at : at + size * n].reshape(size, n).T).view(kind).ravel())
        at += size * n
    return out


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _cuts(parts: int) -> list[int]:
    """Where each of ``parts`` equal ranges of hashes begins."""
    return [i * ((1 << 64) // parts + 1) - (1 << 63) for i in range(parts)]


def _sightings(kind: int, chunk: int, parts: int, grams: np.ndarray, docs: np.ndarray, good: np.ndarray) -> Iterator[tuple]:
    """Rows of ``PACKED`` for each hash range: its n-grams, in how many documents of the chunk each is, and how often in which."""
    order = np.argsort(grams, kind="stable")  # documents come in order: they stay so within an n-gram
    grams, docs = grams[order], docs[order]
    new = np.concatenate([[True], grams[1:] != grams[:-1]])
    entry = np.flatnonzero(new | np.concatenate([[True], docs[1:] != docs[:-1]]))
    times = np.diff(np.append(entry, len(grams)))
    first = np.flatnonzero(new[entry])
    grams, docs = grams[entry[first]], docs[entry]
    target = np.add.reduceat(np.where(good[docs], times, 0), first)
    first = np.append(first, len(docs))
    cuts = np.searchsorted(grams, np.array(_cuts(parts)[1:], np.int64))
    for part, (i, j) in enumerate(zip([0, *cuts.tolist()], [*cuts.tolist(), len(grams)])):
        if i < j:
            a, b = first[i], first[j]
            step = np.diff(grams[i:j].view(np.uint64), prepend=np.uint64(0))
            data = _packed(step, np.diff(first[i : j + 1]).astype(np.uint16), target[i:j].astype(np.uint32), docs[a:b].astype(np.uint16), times[a:b].astype(np.uint32))
            yield part, chunk, kind, j - i, int(b - a), data


def _added(held: Held, kind: int, rows: list[tuple]) -> Iterator[tuple]:
    """What the n-grams of a hash range add to the sums of documents, in which they count as seen once: rows of ``PACKED``."""
    lists = []
    for _, chunk, _, a, b, data in rows:
        step, n, target, docs, times = _unpacked(data, (np.uint64, a), (np.uint16, a), (np.uint32, a), (np.uint16, b), (np.uint32, b))
        n = n.astype(np.int64)
        raw = np.add.reduceat(times.astype(np.int64), np.cumsum(n) - n)
        lists.append((chunk, np.cumsum(step), n, raw, target, docs, times))
    _, where = np.unique(np.concatenate([x[1] for x in lists]), return_inverse=True)
    raw, target = (np.bincount(where, np.concatenate([x[i] for x in lists])) for i in (3, 4))
    ratio, once = _log_ratio(raw, target, held.shares[kind]), held.once(kind)
    values, at = (ratio - once, _excess(ratio) - _excess(np.int64(once))), 0
    for chunk, grams, n, _, _, docs, times in lists:
        here = where[at : at + len(grams)]
        at += len(grams)
        sums = [np.bincount(docs, np.repeat(v[here], n) * times.astype(np.int64)).astype(np.int64) for v in values]
        some = np.flatnonzero((sums[0] != 0) | (sums[1] != 0))
        if len(some):
            yield chunk, chunk, kind, len(some), 0, _packed(some.astype(np.uint16), *(x[some] for x in sums))


def measured_texts(texts: DataFrame, hot_grams: int) -> DataFrame:
    """Rows (doc_id, n, sums, good, model, _k1, _k2) of all rows (doc_id, text, good, model).

    ``n``: words and pairs. ``sums``: for words and for pairs, the sums of the
    ratios and of the excesses below ``FOREIGN`` over the n-grams of a text.
    """
    held, total = held_model(texts, hot_grams)
    parts = (total // RANGE_GRAMS // PASSES + 1) * PASSES
    texts = texts.select("doc_id", "text", "good", "model", *row_key("doc_id", "text"))
    first, *others = (_range_sums(texts, held, parts, i * parts // PASSES, (i + 1) * parts // PASSES) for i in range(PASSES))
    for more in others:  # rows of one key are one text, which has one sum
        more = more.select("_k1", "_k2", F.col("sums").alias("more")).dropDuplicates(["_k1", "_k2"])
        both = F.zip_with("sums", "more", lambda x, y: x + y)
        first = first.join(more, ["_k1", "_k2"]).withColumn("sums", both).select(*MEASURED.names)
    return stage(first)


def _range_sums(texts: DataFrame, held: Held, parts: int, begin: int, end: int) -> DataFrame:
    """``measured_texts`` with the sums of the n-grams in the hash ranges from ``begin`` to before ``end``."""
    shared = texts.sparkSession.sparkContext.broadcast(held)
    low, high = _cuts(parts)[begin], [*_cuts(parts), 1 << 63][end] - 1

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, chunk = shared.value, TaskContext.get().partitionId() << 32
        done: list[pa.RecordBatch] = []
        found: tuple[list, list] = ([], [])
        n_docs = n_grams = 0

        def full() -> Iterator[pa.RecordBatch]:
            docs = pa.Table.from_batches(done).combine_chunks().to_batches()[0]
            good = np.concatenate([_in_target(b.select(["doc_id", "n", "good", "model"])) for b in done])
            yield _rows([(-1 - chunk, chunk, -1, docs.num_rows, 0, docs.serialize().to_pybytes())], PACKED)
            for kind in (0, 1):
                grams, where = (np.concatenate([x[i] for x in found[kind]]) for i in (0, 1))
                found[kind].clear()
                if len(grams):
                    rows = list(_sightings(kind, chunk, parts, grams, where, good))
                    del grams, where
                    for i in range(0, len(rows), 64):
                        yield _rows(rows[i : i + 64], PACKED)
            done.clear()

        for whole in batches:
            for batch in slices(whole, "text"):
                single, at, pairs, pair_at = ngrams(batch.column(1))
                sums = []
                for kind, grams, begins in ((0, single, at), (1, pairs, pair_at)):
                    spot, there = mine.find(kind, grams)
                    ratio = np.full(len(grams), mine.once(kind), np.int64)
                    ratio[there] = mine.ratios[kind][spot[there]]
                    here = (grams >= low) & (grams <= high)
                    there |= ~here
                    for value in (ratio, _excess(ratio)):
                        upto = np.concatenate([[0], np.cumsum(np.where(here, value, 0))])
                        sums.append(upto[begins[1:]] - upto[begins[:-1]])
                    where = np.repeat(np.arange(n_docs, n_docs + batch.num_rows, dtype=np.int32), np.diff(begins))
                    found[kind].append((grams[~there], where[~there]))
                    n_grams += len(found[kind][-1][0])
                n = np.stack([np.diff(at), np.diff(pair_at)], axis=1)
                lists = [pa.array(list(x), pa.list_(pa.int64())) for x in (n, np.stack(sums, axis=1))]
                done.append(pa.RecordBatch.from_arrays([batch.column(0), *lists, *batch.columns[2:]], schema=MEASURED))
                n_docs += batch.num_rows
                if n_grams >= PACKED_GRAMS or n_docs > (1 << 15):
                    yield from full()
                    chunk += 1
                    n_docs = n_grams = 0
        if n_docs:
            yield from full()

    def sorted_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield tuple(c[i].as_py() for c in batch.columns)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, kind), rows in groupby(sorted_rows(batches), lambda r: (r[0], r[2])):
            if kind < 0:
                yield _rows(list(rows), PACKED)
            elif made := list(_added(shared.value, kind, list(rows))):
                yield _rows(made, PACKED)

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groupby(sorted_rows(batches), lambda r: r[1]):
            head = next(rows)
            docs = pa.ipc.read_record_batch(pa.py_buffer(head[5]), MEASURED)
            sums = _numbers(docs.column(2), 4).copy()
            for _, _, kind, a, _, data in rows:
                some, *values = _unpacked(data, (np.uint16, a), (np.int64, a), (np.int64, a))
                for i, value in enumerate(values):
                    sums[some, 2 * kind + i] += value
            new = docs.set_column(2, MEASURED.field(2), pa.array(list(sums), pa.list_(pa.int64())))
            for i in range(0, new.num_rows, 4096):
                yield new.slice(i, 4096)

    packed = texts.mapInArrow(pack, PACKED_DDL)
    added = packed.repartition(end - begin, "part").sortWithinPartitions("part", "kind").mapInArrow(add, PACKED_DDL)
    return stage(added.repartition("chunk").sortWithinPartitions("chunk", "kind").mapInArrow(unite, MEASURED_DDL))


def document_features(n: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """The features of texts.

    For words and for pairs: the mean log ratio, within -1 and 1, and the log of
    the total excess below ``FOREIGN``; last the log of the number of words.
    """
    columns = []
    for pair in (0, 1):
        ratio, excess = sums[:, 2 * pair] / float(SCALE), sums[:, 2 * pair + 1] / float(SCALE)
        columns.append(np.clip(ratio / np.maximum(n[:, pair], 1), -1, 1))  # beyond this a document is lost or safe anyway
        columns.append(np.array([math.log1p(-x) for x in excess.tolist()]))
    columns.append(np.array([math.log1p(x) for x in n[:, 0].tolist()]))
    return np.stack(columns, axis=1)


def gumbel(doc_id: int | None) -> float:
    """Noise that depends on the id only."""
    h = mix(np.array([0x7F4A7C15 if doc_id is None else doc_id], np.int64).astype(np.uint64) + np.uint64(77))[0]
    return -math.log(-math.log((int(h >> np.uint64(11)) + 0.5) / (1 << 53)))


class Selector:
    """Fitted weights and keys of documents, and the least key that is kept."""

    def __init__(self, coefficients: list[float], intercept: float):
        self.coefficients, self.intercept = coefficients, intercept
        self.threshold = -math.inf

    def keys(self, ids: pa.Array, n: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log weight, key) of documents; minus infinity for documents without words."""
        weight = np.full(len(n), self.intercept)
        for i, c in enumerate(self.coefficients):
            weight = weight + found[:, i] * c
        noise = np.array([gumbel(i) for i in ids.to_pylist()]) * TEMPERATURE
        return np.where(n > 0, weight, -np.inf), np.where(n > 0, weight + noise, -np.inf)


def _numbers(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(-1, width)


def fit_selector(docs: DataFrame, labels: DataFrame, hot_grams: int = HOT_GRAMS) -> tuple[Selector, DataFrame]:
    """Fit on the whole corpus and the labelled sample. Also rows (doc_id, _k1, _k2, log_weight, gumbel_key) of all documents."""
    tuned(docs.sparkSession)
    texts = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    sample = stage(_labelled(labels))
    texts = texts.join(F.broadcast(sample), "doc_id", "left").select("doc_id", "text", "good", "model")
    measured = measured_texts(texts, hot_grams)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = document_features(_numbers(batch.column(0), 2), _numbers(batch.column(1), 4))
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.list_(pa.float64())), batch.column(2)], ["f", "good"])

    known = measured.where("good IS NOT NULL AND NOT model AND n[0] > 0").select("n", "sums", "good")
    known = stage(known.mapInArrow(featured, "f array<double>, good int"))
    selector = Selector([0.0] * FEATURES, 0.0)
    both = known.agg(F.countDistinct("good")).first()[0] == 2
    if both:
        rows = known.select(F.col("good").cast("double").alias("label"), array_to_vector("f").alias("features"))
        fitted = LogisticRegression(maxIter=100, regParam=1e-4).fit(rows)
        selector = Selector([float(c) for c in fitted.coefficients], float(fitted.intercept))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = _numbers(batch.column(3), 2)
            weight, key = selector.keys(batch.column(0), n[:, 0], document_features(n, _numbers(batch.column(4), 4)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weight), pa.array(key)], ["doc_id", "_k1", "_k2", "log_weight", "gumbel_key"])

    weighed = measured.select("doc_id", "_k1", "_k2", "n", "sums").mapInArrow(weigh, "doc_id long, _k1 long, _k2 long, log_weight double, gumbel_key double")
    weighed = stage(weighed)
    if both:
        drawn = weighed.where("log_weight > 0").count()
        finite = weighed.where(F.col("gumbel_key") > float("-inf"))
        least = kth_largest(finite, "gumbel_key", drawn)
        selector.threshold = math.inf if least is None else least
    else:
        selector.threshold = -1e300
    return selector, weighed


def score_quality(docs: DataFrame, labels: DataFrame, hot_grams: int = HOT_GRAMS) -> DataFrame:
    """Rows (doc_id, log_weight, gumbel_key, kept) for all rows of ``docs``.

    Null, empty and blank texts have no n-gram: weight and key minus infinity,
    not kept. Ties in the key are kept or left out together. If the labels hold
    no good or no other document, nothing can be told apart: weights are 0 and
    every text with words is kept. Labels without document, with nulls or
    contradictions do no harm; repeated rows are scored each; other columns are
    ignored; no rows give no rows. ``hot_grams`` bounds what a task holds and
    does not change the result.
    """
    selector, weighed = fit_selector(docs, labels, hot_grams)
    return weighed.drop("_k1", "_k2").withColumn("kept", F.col("gumbel_key") >= F.lit(selector.threshold))


def select_quality(docs: DataFrame, labels: DataFrame, hot_grams: int = HOT_GRAMS) -> DataFrame:
    """The rows of ``docs`` that are drawn, with all their columns."""
    selector, weighed = fit_selector(docs, labels, hot_grams)
    inner, columns = numbered(docs, "doc_id", "text")
    inner = inner.withColumn("doc_id", F.col("doc_id").cast("long"))
    drawn = weighed.where(F.col("gumbel_key") >= F.lit(selector.threshold)).select("_k1", "_k2").distinct()
    keyed = inner.select("*", *row_key("doc_id", "text")).join(drawn, ["_k1", "_k2"], "left_semi")
    return keyed.drop("_k1", "_k2", "doc_id", "text").toDF(*columns)
