import random

import public_tokenizers
from tokenizers import Tokenizer, models, pre_tokenizers

from webcorpus.llm.tokencount import Counter, count_tokens, unigram_vocabulary

PATH = public_tokenizers.path("piece_bpe_32k.model")


def library(pieces, unknown):
    tokenizer = Tokenizer(models.Unigram(pieces, unknown, False))
    tokenizer.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


def test_counts_are_the_tokenizers():
    vocabulary = unigram_vocabulary(PATH)
    expected, counter, rng = library(*vocabulary), Counter(*vocabulary), random.Random(2)
    texts = ["", " ", "  a", "a  b ", "x▁y ▁", "日本語🙂🙂x🙂", "a" * 3000, "line\nnext\ttab"]
    texts += ["".join(rng.choice("abe ▁é🙂the in") for _ in range(rng.randint(0, 30))) for _ in range(800)]
    assert [counter.text(t) for t in texts] == [expected(t) for t in texts]


def test_ties_of_a_small_vocabulary():
    pieces = [("<unk>", 0.0), ("▁", -1.0), ("a", -1.0), ("aa", -2.0), ("b", -1.0), ("ab", -2.0), ("ba", -2.0), ("▁a", -2.0), ("aba", -3.0)]
    expected, counter, rng = library(pieces, 0), Counter(pieces, 0), random.Random(4)
    for _ in range(500):
        text = "".join(rng.choice("abc ") for _ in range(rng.randint(0, 12)))
        assert counter.text(text) == expected(text), text


def test_edges(docs, edge_rows):
    got = sorted(count_tokens(docs(edge_rows), PATH).collect(), key=str)
    counter = Counter(*unigram_vocabulary(PATH))
    expected = [(i, counter.text(t or ""), None if t is None else len(t)) for i, t in edge_rows]
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, expected))
    assert count_tokens(docs([]), PATH).count() == 0
