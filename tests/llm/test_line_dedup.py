import random

from webcorpus.llm.line_dedup import dedup_lines


def brute(rows, size=3):
    """Expected texts; rows that agree in id and text are one document."""
    seen, out = set(), {}
    for doc_id, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        lines = text.split("\n") if text is not None else []
        gone = set()
        for i in range(len(lines) - size + 1):
            window = tuple(lines[i : i + size])
            if window in seen:
                gone |= set(range(i, i + size))
            seen.add(window)
        out[doc_id, text] = text if not gone else "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def test_against_brute_force(docs):
    rng = random.Random(5)
    rows = [(i, "\n".join(rng.choice("abc") for _ in range(rng.randint(0, 9)))) for i in range(60)]
    got = {r.doc_id: r.text for r in dedup_lines(docs(rows)).collect()}
    assert got == {i: text for (i, _), text in brute(rows).items()}
    assert any(not t for i, t in got.items() if dict(rows)[i])


def test_edges_and_other_columns(docs, edge_rows):
    df = docs(edge_rows)
    got = dedup_lines(df)
    assert got.columns == df.columns
    expected = brute(edge_rows)
    key = lambda p: (p[0] or -1, p[1] or "")
    assert sorted(((r[1], r[3]) for r in got.collect()), key=key) == sorted(((i, expected[i, t]) for i, t in edge_rows), key=key)
    assert all(r[0] == "other" and r[6] == "en" for r in got.collect())
    assert dedup_lines(docs([])).count() == 0


def test_repeated_rows_keep_their_lines(docs):
    rows = [(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "x\na\nb\nc\ny")]
    assert sorted((r.doc_id, r.text) for r in dedup_lines(docs(rows)).collect()) == [(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "x\ny")]


def test_a_text_of_100_000_lines(docs):
    """Work is in proportion to the lines; the second half repeats the first."""
    half = [f"line {i}" for i in range(50_000)]
    got = {r.doc_id: r.text for r in dedup_lines(docs([(1, "\n".join(half + half + ["end"])), (2, "a\n" + "\n".join(half[7:12]) + "\nb")])).collect()}
    assert got == {1: "\n".join([*half, "end"]), 2: "a\nb"}
