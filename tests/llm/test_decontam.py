import random

from webcorpus.llm.decontam import Matcher, decontaminate, leaks, normalised


def distance(item, text):
    """Least edits between the item and any part of the text, by the full table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        before, row[0] = row[:], i
        for j, d in enumerate(text, 1):
            row[j] = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (c != d))
    return min(row)


def edited(rng, text, n):
    out = list(text)
    for _ in range(n):
        i = rng.randrange(len(out))
        kind = rng.random()
        if kind < 0.4:
            out[i] = rng.choice("abcdefgh")
        elif kind < 0.7:
            del out[i]
        else:
            out.insert(i, rng.choice("abcdefgh"))
    return "".join(out)


def test_against_the_full_table():
    rng = random.Random(1)
    items = [(i, normalised("".join(rng.choice("abcdefgh ") for _ in range(rng.randint(40, 120))))) for i in range(12)]
    matcher = Matcher(items, 0.1)
    for _ in range(120):
        item_id, item = rng.choice(items)
        text = normalised(
            "".join(rng.choice("abcdefgh ") for _ in range(60)) + edited(rng, item, rng.randint(0, len(item) // 6))
            + "".join(rng.choice("abcdefgh ") for _ in range(60))
        )
        got = {m[0]: m[1:] for m in matcher.matches(text)}
        for other, words in items:
            least = distance(words, text)
            assert (other in got) == (least <= int(0.1 * len(words)))
            if other in got:
                d, start, stop = got[other]
                assert d == least == distance(words, text[start:stop])


ITEM = "which of these rivers flows into the northern sea after the long bend"


def test_tables(spark, docs, edge_rows):
    items = spark.createDataFrame(
        [(1, ITEM), (2, ITEM.upper() + " "), (3, "short"), (4, None), (None, ITEM), (5, ""), (6, "another item that no text holds anywhere at all")],
        "item_id long, text string",
    )
    rows = edge_rows + [(20, "x " + ITEM.replace(" ", "\n") + " y"), (21, ITEM.replace("rivers", "rivors")), (22, ITEM[:40]), (20, "x " + ITEM.replace(" ", "\n") + " y")]
    got = sorted(tuple(r) for r in leaks(docs(rows), items).collect())
    assert got == [(20, 1, 0, 2, 2 + len(ITEM)), (20, 1, 0, 2, 2 + len(ITEM)), (21, 1, 1, 0, len(ITEM))]
    df = docs(rows)
    clean = decontaminate(df, items)
    assert clean.columns == df.columns
    assert sorted(str(r[1]) for r in clean.collect()) == sorted(str(i) for i, _ in rows if i not in (20, 21))
    assert leaks(docs([]), items).count() == 0
    assert leaks(df, items.limit(0)).count() == 0 and decontaminate(df, items.limit(0)).count() == len(rows)


def test_items_in_blocks(spark, docs, monkeypatch):
    import webcorpus.llm.decontam as d

    items = spark.createDataFrame([(i, f"{i} " + ITEM[::-1] + f" {i}") for i in range(30)], "item_id long, text string")
    assert sum(len(b) for b in d.item_blocks(items, block_chars=300)) == 30
    monkeypatch.setattr(d.item_blocks, "__defaults__", (300, d.MIN_CHARS))
    got = leaks(docs([(1, f"7 {ITEM[::-1]} 7")]), items).collect()
    assert (1, 7, 0) in [tuple(r)[:3] for r in got]
