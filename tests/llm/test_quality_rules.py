import itertools
import random
import re

import numpy as np
import pytest

from webcorpus.llm import crf
from webcorpus.llm.quality_rules import N_FEATURES, SHAPES, fit_lines, label_lines, rate_documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    words = WORD.findall(text or "")
    windows = list(zip(words, words[1:], words[2:]))
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered), failed


def random_text(rng):
    pick = ["a", "b", "c", "ÉÀ", "中文", "x#y", "<b>", " ", "n|", "1,2", " ", "\x1c"]
    return "".join(rng.choice(pick[: rng.randint(3, 12)]) + rng.choice(" \t\n\r\x0b\x0c  \n") for _ in range(rng.randint(0, 150)))


def texts_of(spark, n=240):
    """Labelled texts with good and bad lines, three languages of shapes; rows (doc_id, text, good)."""
    rng = random.Random(2)
    rows = []
    for i in range(n):
        good = i % 3 > 0
        lines = [" ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(rng.randint(12, 30))) + "." for _ in range(6)]
        if not good:
            mark = rng.choice([lambda w: w.upper() + "!!", lambda w: w + "%%%", lambda w: w + " |"])
            lines = lines[:1] + [" ".join(map(mark, x.split())) for x in lines[1:]]
        rows.append((i, "\n".join(lines), good))
    return rows


@pytest.fixture(scope="module")
def field(spark):
    rows = texts_of(spark)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(good), 7) for i, _, good in rows] + [(None, 1, 0), (3, None, 0), (9_999, 0, 0)], "doc_id long, quality int, text int")
    return fit_lines(docs, labels)


def test_counts_against_brute_force(docs, edge_rows, field):
    rng = random.Random(4)
    rows = edge_rows + [(100 + i, random_text(rng)) for i in range(150)]
    found = rate_documents(docs(rows), field).collect()
    keys = sorted(((r.doc_id, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)) for r in found), key=repr)
    short = [(i, t) for i, t in rows if len(t or "") < 10_000]
    assert sorted(((i, base(t)) for i, t in short), key=repr) == [k for k in keys if k[1][0] < 10_000]
    long = next(r for r in found if r.n_words > 10_000)
    assert (long.n_words, long.n_repeat_words, long.base_failed, long.kept) == (40_000, 40_000, True, False)
    assert not any(r.kept for r in found if r.base_failed)


def test_lines_and_verdict(spark, field):
    rows = texts_of(spark, 60)
    docs = spark.createDataFrame([r[:2] for r in rows] + [(1000, None)], "doc_id long, text string")
    verdict = {r.doc_id: r.kept for r in rate_documents(docs, field).collect()}
    assert verdict == {i: good for i, _, good in rows} | {1000: False}
    lines = {(r.doc_id, r.line): r.content for r in label_lines(docs, field).collect()}
    assert lines == {(i, n): good or n == 0 for i, _, good in rows for n in range(6)}


def test_without_labels_every_line_is_content(spark, docs):
    rows = [(1, " ".join(f"w{i}" for i in range(60)))]
    none = spark.createDataFrame([], "doc_id long, quality int")
    one = spark.createDataFrame([(1, 0)], "doc_id long, quality int")
    for labels in (none, one):
        assert [r.kept for r in rate_documents(docs(rows), fit_lines(docs(rows), labels)).collect()] == [True]
    assert rate_documents(docs([]), fit_lines(docs([]), none)).count() == 0


def paths(field, rows):
    """Score of every labelling."""
    u = field.scores(rows)
    for y in itertools.product((0, 1), repeat=len(rows)):
        yield y, field.first[y[0]] + sum(u[t] for t in range(len(y)) if y[t]) + sum(field.moves[a, b] for a, b in zip(y, y[1:]))


def test_viterbi_against_all_labellings():
    rng = np.random.default_rng(1)
    for _ in range(60):
        field = crf.Field(rng.normal(size=9), rng.normal(size=(2, 2)), rng.normal(size=2))
        rows = rng.integers(0, 9, size=(rng.integers(1, 8), 3))
        assert tuple(field.decode(field.scores(rows).tolist())) == max(paths(field, rows), key=lambda p: p[1])[0]
    tied = crf.Field(np.zeros(9), np.zeros((2, 2)), np.zeros(2))
    assert tied.decode([0.0] * 4) == [0] * 4 and tied.decode([]) == []


def test_fit_reaches_the_largest_penalised_likelihood():
    """At the optimum the mean gradient, computed from all labellings, equals the penalty's."""
    rng = np.random.default_rng(2)
    sequences = [rng.integers(0, 5, size=(n, 2)) for n in (1, 3, 4, 2, 4)]
    labels = [rng.integers(0, 2, size=len(s)) for s in sequences]
    field = crf.fit(sequences, labels, 5, steps=4_000, penalty=0.05)
    weights, moves, first, items = np.zeros(5), np.zeros((2, 2)), np.zeros(2), 0
    for rows, gold in zip(sequences, labels):
        every = list(paths(field, rows))
        chance = np.exp([s for _, s in every])
        for y, p in [(tuple(gold), 1.0), *[(y, -c / chance.sum()) for (y, _), c in zip(every, chance)]]:
            for t, label in enumerate(y):
                np.add.at(weights, rows[t], p * label)
            for a, b in zip(y, y[1:]):
                moves[a, b] += p
            first[y[0]] += p
        items += len(rows)
    for g, value in ((weights, field.weights), (moves, field.moves), (first, field.first)):
        np.testing.assert_allclose(g / items, 0.05 * value, atol=2e-3)


def test_every_line_has_all_shapes():
    from webcorpus.llm.quality_rules import features, read_text

    found = features([read_text("One line.\n\nTWO!! 2\nx"), read_text(""), read_text("é")])
    assert found.shape == (4, SHAPES) and found.min() >= 0 and found.max() < N_FEATURES
    assert (np.diff(found, axis=1) > 0).all()
