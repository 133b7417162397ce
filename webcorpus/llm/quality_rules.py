"""Quality rules: counts of a text, and lines labelled content or boilerplate by a conditional random field.

A text fails the base rules when it is short or mostly repeats itself. Of the
others, every line with a word becomes ``SHAPES`` features of its shape (no words
of any language among them), the field's best labels are read by Viterbi, and
the text is kept when enough of its words stand in content lines.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webcorpus.llm.common import pick, tuned
from webcorpus.llm.crf import BOILERPLATE, CONTENT, Field, fit
from webcorpus.llm.wordhash import slices

#: Base rules: fewest words, and the largest percentage of words in repeated windows of ``WINDOW`` words.
MIN_WORDS, MAX_REPEATED, WINDOW = 50, 50, 3
#: Least share of the words in content lines for a text to be kept.
MIN_CONTENT = 0.5
#: The field is fitted on at most so many labelled texts of each label, drawn by hash, with at most so many lines.
LABELLED_TEXTS, LABELLED_LINES = 2_000, 1_000

SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\x0b\x0c\r"
_UPPER, _LOWER, _DIGITS, _CALLS, _OTHER = bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789", b"!?", bytes(range(128, 256))

#: Upper ends of the classes of each measured value; a value is of the first class whose end it does not exceed.
_CLASSES = {
    "words": (2, 5, 10, 20, 50),
    "letters a word": (2, 3, 4, 5, 7, 10),
    "symbols a word": (0, 0.05, 0.2, 0.5),
    "capitals a letter": (0, 0.02, 0.05, 0.1, 0.3, 0.6),
    "digits a character": (0, 0.02, 0.1, 0.3),
    "calls a word": (0, 0.05, 0.2, 0.5),
    "repeated words": (0, 0.1, 0.3, 0.6),
    "different words": (0.3, 0.5, 0.7, 0.85, 0.99),
    "other bytes a character": (0, 0.1, 0.4),
}
_ENDS = [np.array(ends) for ends in _CLASSES.values()]
_OFFSETS = np.concatenate([[0], np.cumsum([len(e) + 1 for e in _ENDS])])
#: Features beyond the classes: seen before or not; end of a sentence, another sign or neither; first, last, only or inner line.
_SEEN, _END, _PLACE = (int(_OFFSETS[-1]) + x for x in (0, 2, 5))
N_FEATURES = _PLACE + 4
#: Features of one line.
SHAPES = len(_ENDS) + 3


class Reading(NamedTuple):
    """Counts of a text and what is measured of its lines with a word."""

    word_chars: int
    n_words: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    #: Numbers of the lines with a word, their words, measured values and other features.
    lines: list[int]
    words: list[int]
    values: list[tuple]
    marks: list[tuple[int, int, int]]


def _without(line: bytes, signs: bytes) -> int:
    """How many bytes of ``line`` are among ``signs``."""
    return len(line) - len(line.translate(None, signs))


def repeated(words: list[bytes], size: int = WINDOW) -> bytearray:
    """1 for every word in a window of ``size`` words that the text holds twice or more."""
    covered = bytearray(len(words))
    windows = list(zip(*[words[i:] for i in range(size)]))
    counts = Counter(windows)
    if len(counts) < len(windows):
        mark = b"\1" * size
        for i, window in enumerate(windows):
            if counts[window] > 1:
                covered[i : i + size] = mark
    return covered


def read_text(text: str) -> Reading:
    """Counts and line measures of a whole text."""
    rows = text.encode("utf-8", "surrogatepass").split(b"\n")
    split = [row.split() for row in rows]
    words = [w for ws in split for w in ws]
    covered = repeated(words)
    whole, at, dup = {}, 0, 0
    lines, counts, values, marks = [], [], [], []
    filled = [i for i, ws in enumerate(split) if ws]
    last = len(filled) - 1
    for n, i in enumerate(filled):
        ws, line = split[i], rows[i]
        seen = line in whole
        whole[line] = True
        dup += seen
        k = len(ws)
        body = line.translate(None, _SPACE)
        size = len(body)
        upper, lower = _without(body, _UPPER), _without(body, _LOWER)
        lines.append(i)
        counts.append(k)
        values.append((
            k, size / k, _without(body, SYMBOLS) / k, upper / max(upper + lower, 1), _without(body, _DIGITS) / size,
            _without(body, _CALLS) / k, covered.count(1, at, at + k) / k, len(set(ws)) / k, _without(body, _OTHER) / size,
        ))
        end = body[-1:]
        sentence = 0 if end in b".!?" else 1 if end in b",;:|" or end in SYMBOLS else 2
        place = 2 if last == 0 else 0 if n == 0 else 1 if n == last else 3
        marks.append((_SEEN + seen, _END + sentence, _PLACE + place))
        at += k
    size = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    return Reading(size, len(words), sum(map(text.count, SYMBOLS.decode())), dup, covered.count(1), lines, counts, values, marks)


def features(readings: list[Reading]) -> np.ndarray:
    """Feature numbers of all lines of the texts, one row a line."""
    values = np.array([v for r in readings for v in r.values], np.float64).reshape(-1, len(_ENDS))
    marks = np.array([m for r in readings for m in r.marks], np.int64).reshape(-1, 3)
    classes = [np.searchsorted(ends, values[:, j]) + _OFFSETS[j] for j, ends in enumerate(_ENDS)]
    return np.concatenate([np.stack(classes, axis=1), marks], axis=1)


def _readings(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[Reading]]]:
    for batch in batches:
        for part in slices(batch, column):
            yield part, [read_text(t or "") for t in part.column(column).to_pylist()]


def labelled_lines(docs: DataFrame, labels: DataFrame, texts: int = LABELLED_TEXTS) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Features and labels of the lines of at most ``texts`` labelled texts of each quality.

    All lines of a text carry its label: boilerplate for quality 0, content for 1.
    A doc_id with both counts as 0. The draw is by hash, so it is the same anywhere.
    """
    rated = pick(labels, "doc_id", "quality").where("doc_id IS NOT NULL AND quality IS NOT NULL")
    rated = rated.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    drawn = [rated.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(texts) for q in (0, 1)]
    few = pick(docs, "doc_id", "text").where("text IS NOT NULL").join(F.broadcast(drawn[0].union(drawn[1])), "doc_id")
    few = few.where(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) < LABELLED_LINES)
    few = few.orderBy(F.xxhash64("doc_id", "text"), "doc_id").limit(2 * texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, readings in _readings(batches):
            found = [features([r]).ravel().astype(np.int16).tobytes() for r in readings]
            yield pa.RecordBatch.from_arrays([batch.column("quality"), pa.array(found, pa.binary())], ["quality", "lines"])

    rows = few.select("quality", "text").mapInArrow(run, "quality int, lines binary").collect()
    sequences = [np.frombuffer(bytes(r["lines"]), np.int16).reshape(-1, SHAPES).astype(np.int64) for r in rows]
    kinds = [np.full(len(s), CONTENT if r["quality"] else BOILERPLATE) for s, r in zip(sequences, rows)]
    kept = [i for i, s in enumerate(sequences) if len(s)]
    return [sequences[i] for i in kept], [kinds[i] for i in kept]


def fit_lines(docs: DataFrame, labels: DataFrame) -> Field:
    """The field of the labelled texts among ``docs``; with one label only, or none, every line is content.

    A low-quality text may hold good lines, so a first field looks at each of its
    lines alone; those it takes for content are content for the final field, unless
    that leaves none.
    """
    tuned(docs.sparkSession)
    sequences, kinds = labelled_lines(docs, labels)
    first = fit(sequences, kinds, N_FEATURES)
    for i, (sequence, kind) in enumerate(zip(sequences, kinds)):
        bad = first.scores(sequence) > 0
        if kind[0] == BOILERPLATE and bad.any():
            kinds[i] = np.where(bad, BOILERPLATE, CONTENT)
    return fit(sequences, kinds, N_FEATURES)


def _decoded(field: Field, readings: list[Reading]) -> Iterator[list[int]]:
    scores = field.scores(features(readings)).tolist()
    at = 0
    for r in readings:
        yield field.decode(scores[at : at + len(r.lines)])
        at += len(r.lines)


def label_lines(docs: DataFrame, field: Field) -> DataFrame:
    """Rows (doc_id, line, n_words, content) for every line with a word, numbered from 0 over all lines of its text."""
    kind = pa.list_(pa.struct([("line", pa.int64()), ("n_words", pa.int64()), ("content", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, readings in _readings(batches):
            rows = [
                [{"line": i, "n_words": k, "content": x == CONTENT} for i, k, x in zip(r.lines, r.words, found)]
                for r, found in zip(readings, _decoded(field, readings))
            ]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind)], ["doc_id", "lines"])

    texts = pick(docs, "doc_id", "text")
    doc_id = texts.schema["doc_id"].dataType.simpleString()
    out = texts.mapInArrow(run, f"doc_id {doc_id}, lines array<struct<line: bigint, n_words: bigint, content: boolean>>")
    return out.select("doc_id", F.inline("lines"))


def rate_documents(docs: DataFrame, field: Field, min_content: float = MIN_CONTENT) -> DataFrame:
    """Counts and verdict of every row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, content_words, base_failed, kept.

    Words are runs without ASCII white space. A null text counts as empty: it has
    no words, fails the base rules and is not kept. Repeated rows are rated each;
    doc_id may be null. A line that equals an earlier one counts if it has a word.
    """
    tuned(docs.sparkSession)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, readings in _readings(batches):
            content = [sum(k for k, x in zip(r.words, found) if x == CONTENT) for r, found in zip(readings, _decoded(field, readings))]
            failed = [r.n_words < MIN_WORDS or 100 * r.n_repeat_words > MAX_REPEATED * r.n_words for r in readings]
            kept = [not f and c >= min_content * r.n_words for f, c, r in zip(failed, content, readings)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array([getattr(r, n) for r in readings], pa.int64()) for n in names]]
                + [pa.array(content, pa.int64()), pa.array(failed, pa.bool_()), pa.array(kept, pa.bool_())],
                ["doc_id", *names, "content_words", "base_failed", "kept"],
            )

    texts = pick(docs, "doc_id", "text")
    doc_id = texts.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"{n} long" for n in [*names, "content_words"])
    return texts.mapInArrow(run, f"doc_id {doc_id}, {counts}, base_failed boolean, kept boolean")
