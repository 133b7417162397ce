import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from webcorpus.llm.packing import pack_documents, packing_plan
from webcorpus.llm.wordids import WordIds

PATH = public_tokenizers.path("word_bpe_49k.json")


def filled(runs):
    bins, ranks = {}, {}
    for size, rank, n, first, offset, each in runs:
        for k in range(n):
            ranks.setdefault(size, []).append(rank + k)
            bins.setdefault(first + k // each, []).append((offset + k % each * size, size))
    return bins, ranks


@pytest.mark.parametrize("seed", range(60))
def test_plan_places_every_item_once(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 50, 4096])
    counts = {rng.randint(1, capacity): rng.randint(1, 40) for _ in range(rng.randint(0, 12))}
    bins, ranks = filled(packing_plan(counts, capacity))
    assert {s: sorted(r) for s, r in ranks.items()} == {s: list(range(n)) for s, n in counts.items()}
    assert sorted(bins) == list(range(len(bins)))
    for items in bins.values():
        at = 0
        for offset, size in sorted(items):
            assert offset == at
            at += size
        assert at <= capacity


def test_plan_is_as_small_as_can_be_where_pairs_fit_exactly():
    bins, _ = filled(packing_plan({7: 5, 3: 5, 6: 4, 4: 4, 10: 2, 5: 3}, 10))
    assert len(bins) == 5 + 4 + 2 + 2
    assert len(filled(packing_plan({6: 3, 5: 2, 4: 1}, 10))[0]) == 4


def test_wrong_length():
    with pytest.raises(ValueError):
        packing_plan({11: 1}, 10)


def test_word_ids_are_the_tokenizers():
    texts = [
        "", "it's DON'T ,. x,. 1,2. a. b, Foo.", "<|endoftext|> A<|ENDOFTEXT|>b", "İstanbul KK é ñ ﬁ 中文字 🙂hi. ʼn ẞ.",
        "a\x1cb c d e", "ΑΣ. σς", "x" * 5000 + " y",
    ]
    tokenizer, words = Tokenizer.from_file(PATH), WordIds(PATH)
    for _ in range(2):
        got = [np.frombuffer(b, "<u4").tolist() for b in words.texts([t.encode() for t in texts])]
        assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_pieces_round_trip(docs, edge_rows):
    tokenizer = Tokenizer.from_file(PATH)
    rows = pack_documents(docs(edge_rows), PATH).collect()
    expected = []
    for doc_id, text in edge_rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        for piece, at in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[at : at + 4096], "<u4")
            expected.append((doc_id or -1, piece, at, len(part), zlib.crc32(part.tobytes())))
    assert sorted((r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(expected)
    at = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert max(at.values()) <= 4096
    assert pack_documents(docs([]), PATH).count() == 0
