import random
import re

import pytest

from webcorpus.llm.components import connected_components
from webcorpus.llm.near_dup import near_duplicates


def components(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingles(text, size):
    words = [w for w in re.split(r"[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} or ({tuple(words)} if words else set())


def brute(rows, size, percent):
    sets = {i: shingles(t, size) for i, t in rows}
    links = [
        (a, b) for a in sets for b in sets
        if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    return sets, components(sets, links)


def family(rng, n, words, edits, start):
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(words)]
    out = []
    for i in range(n):
        own = list(base)
        for _ in range(rng.randint(0, edits)):
            own[rng.randrange(words)] = f"e{rng.randint(0, 10**6)}"
        out.append((start + i, " ".join(own)))
    return out


@pytest.mark.parametrize("size", [2, 5])
def test_against_brute_force(docs, size):
    rng = random.Random(size)
    rows = family(rng, 60, 150, 14, 0) + family(rng, 40, 60, 4, 100) + family(rng, 30, 8, 1, 200)
    rows += [(300 + i, rows[3][1].upper()) for i in range(5)] + [(400, None), (401, ""), (402, "one"), (403, "ONE"), (404, "two")]
    sets, expected = brute(rows, size, 80)
    got = near_duplicates(docs(rows), size, 80).collect()
    assert {r.doc_id: r.component_id for r in got} == expected
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(s) for i, s in sets.items()}
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and len(got) == len(rows)


def test_edges(docs, edge_rows):
    got = {}
    for r in near_duplicates(docs(edge_rows), 5).collect():
        got.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id, r.kept))
    assert got[1] == got[2] == [(0, 1, True)] or (got[1], got[2]) == ([(0, 1, True)], [(0, 2, True)])
    assert got[5] == [(1, 5, True)] * 2 and got[6] == [(1, 5, False)]
    assert got[4] == [(1, 4, True)]
    assert sorted(got[None]) == [(0, None, True), (1, None, True)]
    assert near_duplicates(docs([])).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_components_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(i, i + 1) for i in range(100, 130)] + [(200, 200)]
    expected = components({x for link in links for x in link}, links)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: c for n, c in expected.items() if n != c}
