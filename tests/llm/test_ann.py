import math
import random

import numpy as np

from webcorpus.llm.ann import nearest


def brute(rows, asked, k):
    good = [
        (i, np.array(v, float)) for i, v in rows
        if i is not None and v is not None and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v) and any(v)
    ]
    out = {}
    for q, v in good:
        if asked(q):
            found = sorted((-float((x * v).sum()), i) for i, x in good if i != q)[:k]
            out[q] = [(n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return out


def test_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(40)]
    rows += [(2000, None), (2001, [0.0] * 8), (2002, [1.0] * 7 + [None]), (2003, [float("nan")] * 8), (2004, [float("inf")] + [0.0] * 7), (2005, [1.0, 2.0]), (None, [1.0] * 8)]
    table = spark.createDataFrame([(i, v, 0.5, "x") for i, v in rows], "vec_id long, embedding array<float>, score double, EMBEDDING string").repartition(5)
    exact = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = {}
    ids = spark.createDataFrame([(i, v) for i, v in rows], "vec_id long, embedding array<float>").where("vec_id % 20 = 0")
    for r in nearest(table, ids, 20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert got == brute(exact, lambda i: i % 20 == 0, 20)


def test_few_candidates_and_none(spark):
    table = spark.createDataFrame([(20, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.1]), (20, [1.0, 0.0])], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in nearest(table, table.where("vec_id = 20"), 20).collect()]
    assert sorted(got) == [(20, 1, 1, 0.5), (20, 2, 2, 0.5)]
    assert nearest(table.limit(0), table, 20).count() == 0
    assert nearest(table, table.limit(0), 20).count() == 0
