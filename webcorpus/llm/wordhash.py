"""Hashes of all words of a batch of texts at once, on the UTF-8 bytes that Arrow holds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = {"n": 0, "up": np.zeros(0, np.uint64), "down": np.zeros(0, np.uint64)}

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACES = [0x20, *range(0x09, 0x0E)]
#: Classes of bytes: 0 white space, 1 anything else.
WORDS = np.ones(256, np.uint8)
WORDS[_SPACES] = 0
#: Classes of bytes: 0 white space, 1 letters and digits (and all bytes of non-ASCII characters), 2 signs.
TOKENS = np.full(256, 2, np.uint8)
TOKENS[_SPACES] = 0
TOKENS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def mix(h: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _grow(n: int) -> None:
    if _powers["n"] < n:
        n = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            step = np.full(n, base, np.uint64)
            step[0] = 1
            _powers[name] = np.multiply.accumulate(step)
        _powers["n"] = n


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and where each begins; nulls are empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of a part hold about ``max_bytes``; a longer text is a part of its own."""
    if not batch.num_rows:
        return
    lengths = np.diff(flat(batch.column(column))[1])
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if total and total + n > max_bytes:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    yield batch.slice(start)


def word_hashes(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, A-Z as a-z, and where each text's words begin.

    A word is a longest run of bytes of one class other than 0. The hash is a
    polynomial over the bytes, read off running sums, so no word is looped over.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    _grow(n)
    kind = classes[data]
    edge = np.empty(n + 1, bool)
    edge[0] = edge[n] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:n])
    edge[offsets] = True
    cuts = np.flatnonzero(edge)
    word = kind[cuts[:-1]] != 0
    starts, ends = cuts[:-1][word], cuts[1:][word]
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * _powers["up"][:n], out=sums[1:])
    h = (sums[ends] - sums[starts]) * _powers["down"][starts]
    h = mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return h, np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every run of ``size`` words; the caller leaves out runs over two texts."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = words[:n].copy()
    for i in range(1, size):
        h = mix(h * np.uint64(0xFF51AFD7ED558CCD) + words[i : n + i])
    return h


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a shorter text is one shingle, an empty one none."""
    words, at = word_hashes(*flat(texts))
    runs = shingle_hashes(words, size)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= size:
            yield np.unique(runs[a : b - size + 1])
        elif b > a:
            tag = np.uint64(0x2545F4914F6CDD1D) * np.uint64(b - a)
            yield mix(shingle_hashes(words[a:b], b - a) + tag)
        else:
            yield np.zeros(0, np.uint64)
