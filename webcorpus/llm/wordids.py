"""Token ids of whole texts through a word cache, for tokenizers that drop white space."""

from __future__ import annotations

import json
from collections.abc import Iterable
from functools import cache

import numpy as np

#: Words of which a worker keeps the ids; when full, the cache starts anew.
CACHED_WORDS = 500_000
#: Longer words are encoded each time.
CACHED_BYTES = 64
#: Words that one call of the tokenizer encodes together.
TOGETHER = 500


class WordIds:
    """Ids of texts as little-endian unsigned 32-bit numbers, computed word by word.

    Holds for tokenizers that treat white space as a boundary which they drop, so
    that a text's ids are those of its words one after the other, lower the case
    of A-Z, and mark the last id of a run of letters by ``</w>``.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        self.last = np.zeros(max(vocabulary.values()) + 1024, bool)
        self.last[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}

    def encode(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, words: Iterable[bytes]) -> dict[bytes, bytes]:
        """Ids of words that are not known yet."""
        out: dict[bytes, bytes] = {}
        signed, runs, rest = [], [], []
        for word in words:
            stem = word[:-1] if word[-1:] in b",." and word[-2:-1].isalnum() else b""
            if stem:
                signed.append((word, stem))
        bare = {stem for _, stem in signed} | {b",", b"."} if signed else set()
        bare.update(words)
        bare.difference_update(word for word, _ in signed)
        for word in bare:
            if word in self.known:
                out[word] = self.known[word]
            elif word.decode("utf-8", "replace").isalpha():
                runs.append(word)
            else:
                rest.append(word)
        for i in range(0, len(runs), TOGETHER):
            group = runs[i : i + TOGETHER]
            joined = b" ".join(group).decode("utf-8")
            ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(group):  # some letter is not one for the tokenizer
                rest += group
                continue
            start = 0
            for word, end in zip(group, ends.tolist()):
                out[word] = ids[start:end].tobytes()
                start = end
        for word in rest:
            out[word] = self.encode(word.decode("utf-8", "replace"))
        for word, stem in signed:
            out[word] = out[stem] + out[word[-1:]]
        return out

    def texts(self, raw: Iterable[bytes | None]) -> Iterable[bytes]:
        """Ids of each text; texts are UTF-8, null is empty."""
        texts = [
            [] if text is None else (text if b"<|" in text else text.lower()).split() for text in raw
        ]
        missing = set().union(*texts).difference(self.known)
        new = self.learn(missing) if missing else {}
        if len(self.known) + len(new) > CACHED_WORDS and self.known:
            self.known = {}
            missing = set().union(*texts)
            new = self.learn(missing)
        self.known.update((w, ids) for w, ids in new.items() if len(w) <= CACHED_BYTES)
        long = {w: ids for w, ids in new.items() if len(w) > CACHED_BYTES}
        get = (self.known | long if long else self.known).__getitem__
        for words in texts:
            yield b"".join(map(get, words))


@cache
def word_ids(path: str) -> WordIds:
    """One encoder for each worker process and vocabulary file."""
    return WordIds(path)
