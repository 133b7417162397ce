import math
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from webcorpus.llm.common import kth_largest
from webcorpus.llm.importance import BATCH_GRAMS, FOREIGN, SCALE, _batches, _merged, measured_texts, ngrams, ratio_model, score_quality, select_quality
from webcorpus.llm.importance import Held, _added, _sightings, _unpacked


def corpus():
    rng = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(1500):
        own = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        kind = rng.random()
        if kind < 0.15:
            own = [w + rng.choice(["&&&", "###"]) for w in own]
        elif kind < 0.3:
            for _ in range(5):
                own[rng.randrange(len(own))] = rng.choice(["slur", "insult"])
        rows.append((i, " ".join(own)))
        labels.append((i, int(kind >= 0.15), int(0.15 <= kind < 0.3)))
    return rows, labels


def test_held_out_accuracy_and_filter(spark, docs):
    rows, labels = corpus()
    known = [x for x in labels if x[0] % 2] + [(None, 1, 0), (9999, None, 0), (1, 1, 1)]
    table = spark.createDataFrame(known, "doc_id long, quality int, toxic int")
    df = docs(rows)
    got = {r.doc_id: r for r in score_quality(df, table).collect()}
    truth = {i: q == 1 and t == 0 for i, q, t in labels if i % 2 == 0}
    wrong = sum(got[i].kept != good for i, good in truth.items())
    assert wrong <= 0.03 * len(truth)
    chosen = select_quality(df, table)
    assert chosen.columns == df.columns
    assert sorted(r[1] for r in chosen.collect()) == sorted(i for i, r in got.items() if r.kept)


def test_models_grow_with_the_corpus(spark, docs):
    """300,000 distinct words: a rare word keeps its own counts, whether tasks hold all n-grams or few."""
    rows = [(i, " ".join(f"v{(i * 500 + j) % 300_000}x" for j in range(500)) + (" slur" if i % 3 == 0 else " fair")) for i in range(1200)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(0, 1200, 2)], "doc_id long, quality int, toxic int")
    texts = spark.createDataFrame([(i, t, int(i % 3 != 0), True) for i, t in rows], "doc_id long, text string, good int, model boolean")
    listed, once = ratio_model(texts)
    words = pa.array([f"v{i}x" for i in range(300_000)] + ["slur", "fair"])
    hashes = ngrams(words)[0].tolist()
    assert len(set(hashes)) == 300_002
    got = {r.h: (r.raw, r.ratio) for r in listed.where("NOT pair").collect()}
    assert [got[h][0] for h in hashes] == [2] * 300_000 + [400, 800]
    share = 2 / 3
    assert abs(got[hashes[-2]][1] / 65536 - math.log(1 / (400 * share + 1))) < 1e-3
    df = docs(rows)
    results = [sorted(map(tuple, score_quality(df, labels, n).collect())) for n in (1 << 22, 10)]
    assert [(r[0], r[3]) for r in results[0]] == [(r[0], r[3]) for r in results[1]]
    assert [x for r in results[0] for x in r[1:3]] == pytest.approx([x for r in results[1] for x in r[1:3]], rel=1e-9)
    chosen = [sorted(r[1] for r in select_quality(df, labels, n).collect()) for n in (1 << 22, 10)]
    assert chosen[0] == chosen[1] == [r[0] for r in results[0] if r[3]]
    assert sum((i % 3 != 0) != k for i, _, _, k in results[0]) <= 12


def test_merging_counts_takes_little_memory():
    """Counts are merged without copies of what is merged, and leave a task in small batches."""
    rng = np.random.default_rng(3)
    parts = []
    for _ in range(4):
        grams = np.unique(rng.integers(0, 300_000, 150_000))
        parts.append((grams, rng.integers(1, 9, len(grams)), rng.integers(0, 2, len(grams))))
    want = {}
    for grams, raw, target in parts:
        for g, r, t in zip(grams.tolist(), raw.tolist(), target.tolist()):
            a, b = want.get(g, (0, 0))
            want[g] = a + r, b + t
    n = sum(len(p[0]) for p in parts)
    tracemalloc.start()
    merged = _merged(parts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert dict(zip(merged[0].tolist(), zip(merged[1].tolist(), merged[2].tolist()))) == want
    assert not parts and most <= 60 * n
    batches = list(_batches(True, *merged))
    assert max(b.num_rows for b in batches) <= BATCH_GRAMS and sum(b.num_rows for b in batches) == len(want)


def test_sightings_are_shuffled_in_few_bytes():
    """Packed n-grams take few bytes, and every range gives documents what its n-grams add to them."""
    rng = np.random.default_rng(5)
    kinds = rng.integers(-(1 << 63), 1 << 63, 60_000)
    held = Held(np.zeros(0, np.int64), np.zeros(0, bool))
    held.shares = [0.4, 0.4]
    chunks, rows, size = [], [], 0
    for chunk in range(3):
        docs = np.sort(rng.integers(0, 300, 40_000)).astype(np.int32)
        grams, good = rng.choice(kinds, 40_000), rng.integers(0, 2, 300).astype(bool)
        chunks.append((grams, docs, good))
        made = list(_sightings(1, chunk, 4, grams, docs, good))
        rows += made
        size += sum(len(r[5]) for r in made)
    n = sum(r[3] for r in rows)
    assert n == sum(len(set(c[0].tolist())) for c in chunks) and size <= 10 * n  # 13.6 bytes a row, without documents, before
    raw, target = {}, {}
    for grams, docs, good in chunks:
        for g, d in zip(grams.tolist(), docs.tolist()):
            raw[g] = raw.get(g, 0) + 1
            target[g] = target.get(g, 0) + int(good[d])
    ratio = {g: round(math.log((target[g] + 1) / (raw[g] * 0.4 + 1)) * SCALE) for g in raw}
    want = np.zeros((3, 300, 2), np.int64)
    for chunk, (grams, docs, _) in enumerate(chunks):
        for g, d in zip(grams.tolist(), docs.tolist()):
            want[chunk, d] += ratio[g] - held.once(1), min(ratio[g] - int(FOREIGN * SCALE), 0)
    got = np.zeros((3, 300, 2), np.int64)
    for part in range(4):
        for _, chunk, _, a, _, data in _added(held, 1, [r for r in rows if r[0] == part]):
            some, *values = _unpacked(data, (np.uint16, a), (np.int64, a), (np.int64, a))
            got[chunk, some] += np.stack(values, axis=1)
    assert np.array_equal(got, want)


def test_sums_do_not_depend_on_what_tasks_hold(spark):
    """Repeated rows, null and blank texts and null ids are measured each, with the sums of the model's ratios."""
    rng = random.Random(8)
    rows = [(i if i % 7 else None, " ".join(rng.choices("a b c d e f g h".split(), k=rng.randint(1, 30))), i % 2, i % 3 == 0) for i in range(400)]
    rows += rows[:20] + [(1, None, None, None), (2, " ", 1, True)]
    texts = spark.createDataFrame(rows, "doc_id long, text string, good int, model boolean")
    listed, once = ratio_model(texts)
    ratio = {(r.pair, r.h): r.ratio for r in listed.collect()}
    want = []
    for i, text, good, model in rows:
        single, _, pairs, _ = ngrams(pa.array([text], pa.string()))
        sums = []
        for pair, grams in ((False, single), (True, pairs)):
            found = [ratio.get((pair, h), once[pair]) for h in grams.tolist()]
            sums += [sum(found), sum(min(x - int(FOREIGN * SCALE), 0) for x in found)]
        want.append((i, [len(single), len(pairs)], sums, good, model))
    for held in (1 << 16, 3, 0):
        got = [(r.doc_id, list(r.n), list(r.sums), r.good, r.model) for r in measured_texts(texts, held).collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_edges(spark, docs, edge_rows):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for labels in (empty, spark.createDataFrame([(5, 1, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")):
        got = score_quality(docs(edge_rows), labels).collect()
        assert len(got) == len(edge_rows)
        assert sorted(str(r.doc_id) for r in got if not r.kept) == ["1", "2", "3", "None"]
        assert select_quality(docs(edge_rows), labels).count() == len(edge_rows) - 4
        assert score_quality(docs([]), labels).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_kth_largest_is_exact(spark, seed):
    rng = random.Random(seed)
    values = [rng.choice([rng.gauss(0, 1), rng.gauss(0, 1e-9) + 5, 5.0, -1e6]) for _ in range(400)]
    table = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "v double")
    ordered = sorted(values, reverse=True)
    for k in (1, 2, 150, 399, 400, 500):
        assert kth_largest(table, "v", k) == ordered[min(k, 400) - 1]
    assert kth_largest(table, "v", 0) is None and kth_largest(table.limit(0), "v", 1) is None
