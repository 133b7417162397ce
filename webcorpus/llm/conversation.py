"""Repair of conversation structure: the cheapest edits that give a legal sequence of roles.

Rows of a conversation are put in order by turn; each becomes one symbol of
``block_tables``. Sorted rows are cut into segments of at most ``SEGMENT``
symbols. A conversation that lies in one segment is repaired at once; one that
spans several is folded: each segment maps every cost vector behind it to the
one before it, one row for each conversation chains these maps from its end, and
the segments are then read for every state before them. A conversation of any
length is so worked on in segments; only its audit is one value.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from webcorpus.llm import block_tables as B
from webcorpus.llm.common import pick, stage, tuned
from webcorpus.session import join_small

#: Symbols of a segment.
SEGMENT = 4_096
_SPACE = " \t\n\x0b\x0c\r"
_STATS = ("blank", "duplicate", "truncated", "illegal")
_LEGAL = {(1, 2), (2, 3), (3, 2)}
#: Columns by which rows of a conversation are put in order; rows alike in all of them are equal.
_ORDER = ["conv_id", "turn", "role", "_h1", "_h2"]


def _text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def damage(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, copies) with a known fault by crc32 of ``conv_id:turn`` modulo 20.

    0 drops the row (no copies), 1 empties its text, 2 removes its sentence ends,
    3 repeats it (two copies), 4 makes it a user's; others stay. Nulls read as one
    space, in the key too; conv_id and turn themselves stay null.
    """
    fault = F.crc32(F.concat_ws(":", _text("conv_id"), _text("turn")).cast("binary")) % 20
    return pick(rows, "conv_id", "turn", "role", "text").select(
        "conv_id", "turn",
        F.when(fault == 4, F.lit("user")).otherwise(_text("role")).alias("role"),
        F.when(fault == 1, F.lit("")).when(fault == 2, F.translate(_text("text"), ".!?", "")).otherwise(_text("text")).alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def _classed(rows: DataFrame) -> DataFrame:
    """Rows with two hashes of conversation, role and text, and their kind: initial + 8 * truncated + 16 * blank."""
    whole = (_text("conv_id"), F.col("role"), F.col("text"))
    tail = F.rtrim(F.col("text"), F.lit(_SPACE))
    begins = F.substring("role", 1, 1)
    initial = F.when(begins == "s", 1).when(begins == "u", 2).when(begins == "a", 3).otherwise(B.OTHER)
    blank = tail == ""
    cut = ~F.substring(tail, -1, 1).isin(".", "!", "?")
    return rows.select(
        "*", F.xxhash64(*whole).alias("_h1"), F.xxhash64(F.lit(7919), *reversed(whole)).alias("_h2"),
        (initial + F.when(blank, 16).when(cut, 8).otherwise(0)).cast("int").alias("_kind"),
    )


class _Segment:
    """Symbols and counts of consecutive rows of one conversation."""

    def __init__(self, conv_id: object) -> None:
        self.conv_id, self.symbols = conv_id, bytearray()
        self.stats = dict.fromkeys(_STATS, 0)
        self.turns, self.low, self.high = 0, None, None
        self.first = self.last = 0

    def add(self, turn: int | None, kind: int, later: bool) -> None:
        initial = kind & 7
        if kind & 16:
            self.stats["blank"] += 1
        elif later:
            self.stats["duplicate"] += 1
        elif kind & 8:
            self.stats["truncated"] += 1
        if self.symbols:
            self.stats["illegal"] += (self.last, initial) not in _LEGAL
        else:
            self.first = initial
        self.last = initial
        if turn is not None and turn != self.high:
            self.turns, self.high = self.turns + 1, turn
            self.low = turn if self.low is None else self.low
        self.symbols.append(B.DELETED if kind & 16 or later else B.symbol(initial, bool(kind & 8)))


_NUMBERS = (*_STATS, "turns", "low", "high", "first", "last")
_SEGMENTS = (
    "part int, idx long, whole boolean, symbols binary, " + ", ".join(f"{n} long" for n in _NUMBERS)
    + ", cost long, audit string, nexts binary, adds array<long>"
)


def _segments(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Segments of the rows of a task, which come in order; conversations inside the task are whole and repaired."""
    part = TaskContext.get().partitionId()
    schema = pa.schema(
        [("conv_id", kind), ("part", pa.int32()), ("idx", pa.int64()), ("whole", pa.bool_()), ("symbols", pa.binary())]
        + [(n, pa.int64()) for n in _NUMBERS]
        + [("cost", pa.int64()), ("audit", pa.string()), ("nexts", pa.binary()), ("adds", pa.list_(pa.int64()))]
    )
    out: list[tuple] = []
    count = 0

    def close(s: _Segment, whole: bool) -> None:
        nonlocal count
        symbols = bytes(s.symbols)
        if whole:
            audit, _, cost = B.edits(symbols)
            nexts = adds = None
        else:
            audit = cost = None
            now, total = B.transitions(symbols)
            nexts, adds = now.astype("uint8").tobytes(), total.tolist()
        out.append((s.conv_id, part, count, whole, None if whole else symbols, *s.stats.values(), s.turns, s.low, s.high, s.first, s.last, cost, audit, nexts, adds))
        count += 1

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out)) or [()] * len(schema)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    segment, edge = None, True
    for batch in batches:
        for conv_id, turn, copies, what, later in zip(*(c.to_pylist() for c in batch.columns)):
            if segment is None or conv_id != segment.conv_id:
                if segment is not None:
                    close(segment, not edge)
                    edge = False
                segment = _Segment(conv_id)
            for n in range(copies):
                if len(segment.symbols) == SEGMENT:
                    close(segment, False)
                    edge, segment = True, _Segment(conv_id)
                segment.add(turn, what, later or n > 0)
        if len(out) >= 512:
            yield flush()
    if segment is not None:
        close(segment, False)
    yield flush()


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Totals of conversations of several segments, and the cost vector behind each segment."""
    kind = pa.list_(pa.struct([("part", pa.int32()), ("idx", pa.int64()), ("behind", pa.int32())]))
    for batch in batches:
        totals, behind = [], []
        for pieces in batch.column("pieces").to_pylist():
            rows = [p for p in pieces if p["first"]]
            total = {n: sum(p[n] for p in pieces) for n in (*_STATS, "turns")}
            turns = [p for p in rows if p["low"] is not None]
            total["low"] = turns[0]["low"] if turns else None
            total["high"] = turns[-1]["high"] if turns else None
            total["turns"] -= sum(a["high"] == b["low"] for a, b in zip(turns, turns[1:]))
            total["illegal"] += sum((a["last"], b["first"]) not in _LEGAL for a, b in zip(rows, rows[1:]))
            vector, cost, found = 0, 0, []
            for p in reversed(pieces):
                found.append({"part": p["part"], "idx": p["idx"], "behind": vector})
                cost, vector = cost + p["adds"][vector], p["nexts"][vector]
            total["cost"] = cost + B.tables().vectors[vector][B.START]
            totals.append(total)
            behind.append(found)
        names = [*_STATS, "turns", "low", "high", "cost"]
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), *[pa.array([t[n] for t in totals], pa.int64()) for n in names], pa.array(behind, kind)],
            ["conv_id", *names, "behind"],
        )


def _readings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edits of a segment and the state after them, for every state before it."""
    for batch in batches:
        ways = [
            [B.edits(symbols, behind, state, last=False)[:2] for state in range(4)]
            for symbols, behind in zip(batch.column("symbols").to_pylist(), batch.column("behind").to_pylist())
        ]
        yield pa.RecordBatch.from_arrays(
            [batch.column(n) for n in ("conv_id", "part", "idx")]
            + [pa.array([[w[0] for w in way] for way in ways], pa.list_(pa.string())), pa.array([[w[1] for w in way] for way in ways], pa.list_(pa.int32()))],
            ["conv_id", "part", "idx", "letters", "leads"],
        )


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The audit of a conversation from the readings of its segments."""
    for batch in batches:
        audits = []
        for pieces in batch.column("pieces").to_pylist():
            state, letters = B.START, []
            for p in pieces:
                letters.append(p["letters"][state])
                state = p["leads"][state]
            audits.append("".join([*letters, B.tables().ends[state]]))
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(audits, pa.string())], ["conv_id", "audit"])


def _grouped(pieces: DataFrame, *names: str) -> DataFrame:
    of = F.sort_array(F.collect_list(F.struct("part", "idx", *names)))
    return pieces.groupBy("conv_id").agg(of.alias("pieces"))


def audit_conversations(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit), one for each conv_id.

    ``rows`` holds conv_id, turn, role, text and copies (how often the row occurs;
    0 names a conversation without rows). Rows are in order of turn, nulls first;
    rows of one turn by role, then by a hash of their text; equal rows are
    adjacent and all but the first are duplicates. Null role and text read as one
    space. A null conv_id is a conversation of its own. An empty table gives none.
    """
    tuned(rows.sparkSession)
    named = pick(rows, "conv_id", "turn", "role", "text", "copies").withColumns({"role": _text("role"), "text": _text("text")})
    kinds = _classed(named).groupBy(*_ORDER).agg(F.sum("copies").alias("copies"), F.max("_kind").alias("_kind"))
    distinct = stage(kinds)
    first = distinct.where("copies > 0").groupBy("_h1", "_h2").agg(F.min(F.struct("turn")).alias("_first"), F.count(F.lit(1)).alias("_n"))
    known = join_small(distinct, first.where("_n > 1").select("_h1", "_h2", "_first"), ["_h1", "_h2"], spread="turn", how="left")
    later = F.col("_first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("_first.turn"))
    ordered = known.withColumn("_later", later).repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER)
    conv = rows.schema["conv_id"].dataType.simpleString()
    fed = ordered.select("conv_id", "turn", "copies", "_kind", "_later")
    kind = to_arrow_type(rows.schema["conv_id"].dataType)
    segments = stage(fed.mapInArrow(lambda batches: _segments(batches, kind), f"conv_id {conv}, {_SEGMENTS}"))

    stats = ["conv_id", *_STATS, "turns", "low", "high", "cost"]
    parts = segments.where("NOT whole")
    chained = stage(
        _grouped(parts, *_NUMBERS, "nexts", "adds").mapInArrow(
            _chain, f"conv_id {conv}, " + ", ".join(f"{n} long" for n in stats[1:]) + ", behind array<struct<part: int, idx: bigint, behind: int>>"
        )
    )
    behind = chained.select(F.inline("behind"))
    read = parts.select("conv_id", "part", "idx", "symbols").join(behind, ["part", "idx"]).mapInArrow(
        _readings, f"conv_id {conv}, part int, idx long, letters array<string>, leads array<int>"
    )
    audits = _grouped(read, "letters", "leads").mapInArrow(_joined, f"conv_id {conv}, audit string")
    same = F.col("l.conv_id").eqNullSafe(F.col("r.conv_id"))
    long = chained.alias("l").join(audits.alias("r"), same).select(*[f"l.{n}" for n in stats], "r.audit")
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0))
    return segments.where("whole").select(*stats, "audit").union(long).select(
        "conv_id", gaps.alias("gaps"), *_STATS, "cost", "audit"
    )


_STREAMED = ["conv_id", "copies", "role", "text", "audit"]


def _streamed(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """Each conversation's audit row followed by its rows in order, a conversation in one task, never in one piece."""
    texts = pick(rows, "conv_id", "turn", "role", "text", "copies").withColumns({"role": _text("role"), "text": _text("text")})
    texts = _classed(texts).where("copies > 0").drop("_kind").withColumn("audit", F.lit(None).cast("string"))
    heads = audits.select("conv_id", "audit").withColumns(
        {n: F.lit(None).cast(texts.schema[n].dataType) for n in ("turn", "role", "text", "_h1", "_h2")} | {"copies": F.lit(None).cast("long")}
    )
    both = texts.unionByName(heads).withColumn("_body", F.col("audit").isNull())
    order = ["conv_id", "_body", *_ORDER[1:]]
    return both.repartition("conv_id").sortWithinPartitions(*order).select(*_STREAMED)


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, str, str | None, str | None]]:
    """(conv_id, letter, role, text) of the rows a repair keeps or writes; ("", None, None) begins a conversation."""
    conv_id, audit, at, state = None, "", 0, B.START

    def inserted() -> Iterator[tuple[object, str, str, str]]:
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            at, state = at + 1, B._NEXT[state]
            yield conv_id, "I", B.written_role(state), ""

    for batch in batches:
        for conv, copies, role, text, new_audit in zip(*(c.to_pylist() for c in batch.columns)):
            if new_audit is not None:
                yield from inserted()
                conv_id, audit, at, state = conv, new_audit, 0, B.START
                yield conv_id, "", None, None
                continue
            for _ in range(copies):
                yield from inserted()
                letter = audit[at]
                at += 1
                if letter == "K":
                    state = B._KEEP[state][B.INITIALS.index(role[0])]
                    yield conv_id, "K", role, text
                elif letter == "R":
                    state = B._NEXT[state]
                    yield conv_id, "R", B.written_role(state), text
    yield from inserted()


def repaired_conversations(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """Rows (conv_id, place, edit, role, text) of the repaired conversations, places gapless from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size, place = [], 0, 0
        for conv_id, letter, role, text in _written(batches):
            if not letter:
                place = 0
                continue
            out.append((conv_id, place, letter, role, text))
            place, size = place + 1, size + len(text)
            if size > 1 << 22 or len(out) == 4_096:
                yield _table(out)
                out, size = [], 0
        yield _table(out)

    conv = rows.schema["conv_id"].dataType.simpleString()
    return _streamed(rows, audits).mapInArrow(run, f"conv_id {conv}, place long, edit string, role string, text string")


def _table(rows: list[tuple]) -> pa.RecordBatch:
    names = ["conv_id", "place", "edit", "role", "text"]
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c) if c else pa.nulls(0) for c in columns], names)


def repaired_digests(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """Rows (conv_id, repaired_sha256): SHA-256 of the repaired ``role:text``, joined by line ends.

    The digest is a chain over the whole conversation, so one task reads it, batch by batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, digests = [], []
        digest, empty = None, True

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(digests, pa.string())], ["conv_id", "repaired_sha256"])
            ids.clear()
            digests.clear()
            return made

        for conv_id, letter, role, text in _written(batches):
            if letter:
                digest.update(f"{'' if empty else chr(10)}{role}:{text}".encode())
                empty = False
                continue
            if digest is not None:
                digests.append(digest.hexdigest())
            if len(digests) == 4_096:
                yield batch()
            digest, empty = hashlib.sha256(), True
            ids.append(conv_id)
        if digest is not None:
            digests.append(digest.hexdigest())
        yield batch()

    kind = to_arrow_type(rows.schema["conv_id"].dataType)
    conv = rows.schema["conv_id"].dataType.simpleString()
    return _streamed(rows, audits).mapInArrow(run, f"conv_id {conv}, repaired_sha256 string")


def repair_report(rows: DataFrame) -> DataFrame:
    """``audit_conversations`` with the digest of the repaired conversation."""
    audits = stage(audit_conversations(rows))
    same = F.col("a.conv_id").eqNullSafe(F.col("d.conv_id"))
    joined = audits.alias("a").join(repaired_digests(rows, audits).alias("d"), same)
    return joined.select("a.*", "d.repaired_sha256")
