import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from webcorpus.llm import block_tables, conversation
from webcorpus.llm.conversation import audit_conversations, damage, repair_report, repaired_conversations

STEPS = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
NAMES = {"u": "user", "a": "assistant"}
SPACE = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """(cost, audit, repaired lines) by plain dynamic programming over (rows read, last initial)."""
    now = {"": (0, "", ())}

    def put(table, last, found):
        if last is not None and (last not in table or found[:2] < table[last][:2]):
            table[last] = found

    def inserted(table):
        for _ in range(3):
            for last, (cost, audit, lines) in list(table.items()):
                for x in "ua":
                    put(table, STEPS.get((last, x)), (cost + 2, audit + "I", (*lines, f"{NAMES[x]}:")))
        return table

    for role, text, gone, cut in rows:
        then = {}
        for last, (cost, audit, lines) in inserted(now).items():
            put(then, last, (cost + 3, audit + "D", lines))
            if not gone:
                put(then, STEPS.get((last, role[:1])), (cost + cut, audit + "K", (*lines, f"{role}:{text}")))
                for x in "ua":
                    put(then, STEPS.get((last, x)), (cost + 2 + cut, audit + "R", (*lines, f"{NAMES[x]}:{text}")))
        now = then
    return min(v for k, v in inserted(now).items() if k in ("", "a"))


def brute(table, damaged=True):
    groups = defaultdict(list)
    for conv, turn, role, text in table:
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        fault = zlib.crc32(key.encode()) % 20 if damaged else 19
        role, text = " " if role is None else role, " " if text is None else text
        role = "user" if fault == 4 else role
        text = "" if fault == 1 else text.translate({46: None, 33: None, 63: None}) if fault == 2 else text
        groups[conv] += [(turn, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    out = {}
    for conv, rows in groups.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        seen, symbols, counts = set(), [], [0, 0, 0]
        for _, role, text in rows:
            tail = text.rstrip(SPACE)
            faults = [not tail, (role, text) in seen, bool(tail) and tail[-1] not in ".!?"]
            seen.add((role, text))
            if any(faults):
                counts[faults.index(True)] += 1
            symbols.append((role, text, faults[0] or faults[1], faults[2]))
        turns = [t for t, _, _ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, audit, lines = cheapest(symbols)
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def rows_of(spark, rows):
    table = [("other", c, t, r, x, 7, 1) for c, t, r, x in rows]
    return spark.createDataFrame(table, "TEXT string, conv_id long, turn long, role string, text string, copies long, _h1 int").repartition(3)


def report(df):
    return {r["conv_id"]: tuple(r)[1:] for r in df.collect()}


def random_rows(seed, conversations, longest=12):
    rng = random.Random(seed)
    rows = []
    for c in range(conversations):
        for turn in sorted(rng.sample(range(40), rng.randint(0, longest))):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            rows.append((c, turn, role, rng.choice(["Yes.", "No", "Why? \n", " \t", None, "", "Well!", f"n{turn}", "中文。"])))
    return rows


@pytest.mark.parametrize("length", range(0, 11))
def test_block_tables_against_plain_programming(length):
    rng = random.Random(length)
    for _ in range(300):
        symbols = bytes(rng.randrange(block_tables.SYMBOLS) for _ in range(length))
        rows = [("suao"[(c - 1) % 4] if c else "o", "", c == 0, c > 4) for c in symbols]
        audit, _, cost = block_tables.edits(symbols)
        assert (cost, audit) == cheapest(rows)[:2]
        cut = rng.randint(0, length)
        behind, added = block_tables.transitions(symbols[cut:])
        first, state, rest = block_tables.edits(symbols[:cut], int(behind[0]), last=False)
        assert first + block_tables.edits(symbols[cut:], 0, state)[0] == audit
        assert rest + added[0] == cost


def test_against_brute_force(spark):
    rows = random_rows(5, 80) + [(None, 1, "user", "a."), (None, None, "assistant", "b."), (500, None, None, None), (501, 3, "user", "word " * 40_000 + ".")]
    rows += [(502, 1, "user", "same.")] * 3 + [(503, -5, "user", "q."), (503, 9, "assistant", "r.")]
    assert report(repair_report(damage(rows_of(spark, rows)))) == brute(rows)


@pytest.mark.parametrize("segment", [1, 3, 5])
def test_conversations_over_many_segments(spark, monkeypatch, segment):
    monkeypatch.setattr(conversation, "SEGMENT", segment)
    rows = random_rows(segment, 12, 35) + [(99, 2, "user", "same.")] * 9 + [(98, t, "user", "again.") for t in range(9)]
    assert report(repair_report(damage(rows_of(spark, rows)))) == brute(rows)


def test_repaired_rows_and_given_copies(spark):
    rows = [(1, 1, "system", "Be kind."), (1, 2, "assistant", "Hello."), (1, 3, "user", "Hi?"), (1, 4, "user", "Hi?"), (2, 1, "user", "Gone.")]
    table = rows_of(spark, rows).withColumn("copies", F.when(F.col("conv_id") == 2, 0).otherwise(1).cast("long"))
    audits = audit_conversations(table)
    found = {r.conv_id: (r.cost, r.audit) for r in audits.collect()}
    assert found == {1: (7, "KIKKDI"), 2: (0, "")}
    out = [tuple(r)[1:] for r in repaired_conversations(table, audits).orderBy("conv_id", "place").collect()]
    assert out == [(0, "K", "system", "Be kind."), (1, "I", "user", ""), (2, "K", "assistant", "Hello."), (3, "K", "user", "Hi?"), (4, "I", "assistant", "")]


def test_empty_table(spark):
    assert repair_report(damage(rows_of(spark, []))).count() == 0
