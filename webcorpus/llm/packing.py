"""Packing of documents into sequences: dominance reduction, then best fit.

The instance is not a list of documents but a table of lengths with counts, of
at most ``capacity`` rows however many documents there are. Martello-Toth
dominance fixes whole runs of equal sequences on it; best fit decreasing places
what is left, again by runs. The plan says which ranks of which length go to
which sequences, and documents look up their place by (length, rank).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webcorpus.llm.common import gapless, pick, stage, tuned
from webcorpus.llm.wordids import word_ids

CAPACITY = 4096
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32): every document's ids and ``end_id``, cut only beyond ``capacity``.

    A null text is an empty one: its only id is ``end_id``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows = []
            texts = batch.column(1).cast(pa.large_binary()).to_pylist()
            for doc_id, ids in zip(batch.column(0).to_pylist(), word_ids(tokenizer_path).texts(texts)):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows)) or [[]] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    tuned(docs.sparkSession)
    return pick(docs, "doc_id", "text").mapInArrow(run, PIECE_SCHEMA)


class _Sequences:
    """The plan under construction: runs of sequences with the same contents."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left = {s: n for s, n in counts.items() if n > 0}
        self.capacity = capacity
        self.used = dict.fromkeys(self.left, 0)
        self.made = 0
        self.runs: list[tuple[int, int, int, int, int, int]] = []  # size, first rank, ranks, sequence, offset, each

    def new(self, n: int) -> int:
        first, self.made = self.made, self.made + n
        return first

    def put(self, size: int, first: int, n: int, offset: int, each: int = 1) -> None:
        """``each`` items of one size into each of ``n`` sequences from ``first`` on, at ``offset``."""
        rank = self.used[size]
        self.runs.append((size, rank, n * each, first, offset, each))
        self.used[size] = rank + n * each
        self.left[size] -= n * each
        if not self.left[size]:
            del self.left[size]


def _reduce(plan: _Sequences) -> None:
    """Martello-Toth dominance: fix sets around the largest item that no other choice can beat.

    For the largest item ``a`` and its room r = capacity - a, in this order:
    nothing left fits into r: {a} alone; an item of exactly r: {a, r}; the best
    single item b that fits is at least as long as any pair that fits (checked by
    the two smallest items not fitting together): {a, b}. Otherwise the item is
    left to best fit and the next smaller one is tried.
    """
    sizes = sorted(plan.left, reverse=True)
    for a in sizes:
        while n := plan.left.get(a, 0):
            room = plan.capacity - a
            small = _smallest(plan.left, a, 2)
            if not small or small[0] > room:
                plan.put(a, plan.new(n), n, 0)
                continue
            b = room if plan.left.get(room, 0) > (room == a) else 0
            if not b and (len(small) < 2 or small[0] + small[1] > room):
                b = max(s for s in plan.left if s <= room and (s != a or n > 1))
            if not b:
                break
            m = n // 2 if a == b else min(n, plan.left[b])
            if a == b:
                plan.put(a, plan.new(m), m, 0, 2)
            else:
                first = plan.new(m)
                plan.put(a, first, m, 0)
                plan.put(b, first, m, a)


def _smallest(left: dict[int, int], a: int, k: int) -> list[int]:
    """The k smallest items beside one item of size ``a``."""
    out: list[int] = []
    for s in sorted(left)[: k + 1]:
        out += [s] * min(k, left[s] - (s == a))
    return out[:k]


def _best_fit(plan: _Sequences) -> None:
    """Best fit decreasing by runs: each size fills the tightest open sequences first."""
    open_runs: dict[int, list[tuple[int, int]]] = {}  # room: (first sequence, how many)
    for size in sorted(plan.left, reverse=True):
        while n := plan.left.get(size, 0):
            room = min((r for r in open_runs if r >= size), default=0)
            if room:
                first, m = open_runs[room].pop()
                if not open_runs[room]:
                    del open_runs[room]
                used = plan.capacity - room
            else:
                each = min(n, plan.capacity // size)
                m = n // each
                first, room, used = plan.new(m), plan.capacity, 0
            each = min(room // size, max(1, n // m))
            take = min(m, n // each)
            plan.put(size, first, take, used, each)
            for rest, at, k in ((room - each * size, first, take), (room, first + take, m - take)):
                if k and rest:
                    open_runs.setdefault(rest, []).append((at, k))


def packing_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (size, first rank, ranks, first sequence, offset, each) for the given number of pieces of each length."""
    if any(not 0 < s <= capacity for s in counts):
        raise ValueError("every length must lie between 1 and the capacity")
    plan = _Sequences(counts, capacity)
    _reduce(plan)
    _best_fit(plan)
    return plan.runs


def assign_sequences(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (a staged table with ``length`` and ``_uid``) with ``sequence_id`` and ``offset``.

    The driver collects one count for each length, at most ``capacity`` numbers,
    and returns the plan, whose size depends on the number of distinct lengths
    only; tasks look places up in it by search.
    """
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    runs = np.array(sorted(packing_plan(counts, capacity)), np.int64).reshape(-1, 6)
    keys = runs[:, 0] << 44 | runs[:, 1]
    ranked = gapless(pieces, ["length"], "_rank").drop("_uid")
    names, schema = ranked.columns, ranked.schema
    at_length, at_rank = names.index("length"), names.index("_rank")
    out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema if f.name != "_rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(at_length).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column(at_rank).to_numpy(zero_copy_only=False).astype(np.int64)
            found = runs[np.searchsorted(keys, length << 44 | rank, side="right") - 1]
            inside = rank - found[:, 1]
            sequence = found[:, 3] + inside // found[:, 5]
            offset = found[:, 4] + inside % found[:, 5] * length
            arrays = [batch.column(i) for i in range(len(names)) if i != at_rank]
            yield pa.RecordBatch.from_arrays(
                [*arrays, pa.array(sequence), pa.array(offset)], [n for n in names if n != "_rank"] + ["sequence_id", "offset"]
            )

    return ranked.mapInArrow(run, f"{out}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    Returns one row per piece: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset. Null and empty texts are one end token; longer documents
    are cut into full pieces and a rest. Repeated rows are packed each; ties in
    length go by the order of the staged table. No rows give no rows.
    """
    pieces = token_pieces(docs, tokenizer_path, end_id, capacity)
    return assign_sequences(stage(pieces.withColumn("_uid", F.monotonically_increasing_id())), capacity)
