import math
import random

import numpy as np
import pyarrow as pa
import pytest

from webcorpus.llm import hard_negatives
from webcorpus.llm.hard_negatives import Anchors, Vectors, encode, mine_hard_negatives

DIM = 8
LONG = 1 << 63


def whole(x):
    return int(x) * 256 if abs(x) > 1e300 else math.floor(256 * x)


def brute(rows, asked):
    good = [
        (i, label, [whole(x) for x in v]) for i, label, v in rows
        if i is not None and label is not None and v is not None and len(v) == DIM and all(x is not None and math.isfinite(x) for x in v)
    ]
    out, seen = [], set()
    for a, label, v in good:
        if not asked(a) or (a, label, tuple(v)) in seen:
            continue
        seen.add((a, label, tuple(v)))
        found = [(-min(max(sum(x * y for x, y in zip(v, w)), -LONG), LONG - 1), i, other == label) for i, other, w in good if not (i == a and other == label)]
        for score, p, _ in sorted(f for f in found if f[2])[:5]:
            fits = sorted(f for f in found if not f[2] and 50 * -score <= 100 * -f[0] <= 95 * -score)[:3]
            out += [(a, p, n + 1, i, -score, -s) for n, (s, i, _) in enumerate(fits)]
    return sorted(out)


def run(spark, rows, asked="vec_id % 50 = 0", kind="float"):
    table = [(1, i, label, v, "x") for i, label, v in rows]
    df = spark.createDataFrame(table, f"score int, vec_id long, label int, embedding array<{kind}>, EMBEDDING string").repartition(4)
    return sorted(tuple(r) for r in mine_hard_negatives(df, df.where(asked)).collect())


def vectors(rng, n, labels=3):
    centres = [[rng.gauss(0, 1) for _ in range(DIM)] for _ in range(labels)]
    return [(i, i % labels, [float(np.float32(c + rng.gauss(0, 1))) for c in rng.choice(centres)]) for i in range(n)]


@pytest.mark.parametrize("block", [2, 4_096])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", block)
    monkeypatch.setattr(hard_negatives, "ROWS", 37)
    rows = vectors(random.Random(3), 400)
    rows += [(1000 + i, i % 3, rows[7][2]) for i in range(60)] + [(2000 + i, 1, [0.0] * DIM) for i in range(5)]
    rows += [(3000, 1, None), (3001, None, [1.0] * DIM), (3002, 1, [1.0] * 7 + [None]), (3003, 2, [float("nan")] * DIM)]
    rows += [(3004, 0, [float("inf")] + [0.0] * 7), (3050, 0, [1.0, 2.0]), (None, 1, [1.0] * DIM), (3100, 1, []), (50, *rows[50][1:])]
    assert run(spark, rows) == brute(rows, lambda i: i % 50 == 0)


def test_components_of_any_size(spark):
    rng = random.Random(8)
    sizes = [1e-300, 1e-3, 1.0, 1e6, 3e9, 1e20, 1e160, 1.5e308]
    rows = [(i, i % 2, [rng.choice([-1, 1]) * rng.random() * s for _ in range(DIM)]) for i, s in enumerate(sizes * 6)]
    assert run(spark, rows, "vec_id % 5 = 0", "double") == brute(rows, lambda i: i % 5 == 0)


def test_intervals_hold_and_are_narrow():
    rng = np.random.default_rng(5)
    for dim in (3, 64, 100):
        x, y = rng.normal(size=(300, dim)), rng.normal(size=(40, dim))
        rows = Vectors(pa.array(list(x)), dim, 256)
        anchors = Anchors(list(range(40)), [0] * 40, y.tolist(), 256)
        low, high = anchors.intervals(*encode(rows), np.arange(40))
        exact = rows.whole @ anchors.vectors.whole.T
        assert (low <= exact).all() and (exact <= high).all()
        length = np.linalg.norm(rows.whole, axis=1)[:, None] * np.linalg.norm(anchors.vectors.whole, axis=1)
        assert dim < 64 or np.median((high - low) / length) < 0.4


def test_few_rows_and_none(spark):
    rows = [(0, 1, [1.0] * DIM), (1, 1, [0.5] * DIM), (2, 2, [0.4] * DIM)]
    assert run(spark, rows) == [(0, 1, 1, 2, 256 * 128 * DIM, 256 * 102 * DIM)] == brute(rows, lambda i: i % 50 == 0)
    assert run(spark, rows[:1]) == []
    assert run(spark, []) == []
    assert run(spark, rows, "vec_id = 77") == []
