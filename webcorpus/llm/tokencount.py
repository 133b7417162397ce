"""Token counts of a unigram model without making the tokens.

An Aho-Corasick automaton of the vocabulary enumerates the pieces that end at
each place of a word; dynamic programming over the places carries the best score
and the number of pieces. Ties go as in the tokenizer's own search: forward over
starting places, only a better score replaces, so among equals the piece that
starts first stays. Neighbouring unknown characters are one piece.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webcorpus.llm.common import pick, tuned

#: What stands for a space in the pieces.
SPACE = "▁"
#: An unknown character costs this much more than the worst piece.
UNKNOWN_PENALTY = 10.0
#: Words whose counts a worker keeps, and their longest length.
CACHED_WORDS, CACHED_CHARS = 500_000, 64


def unigram_vocabulary(model_path: str) -> tuple[list[tuple[str, float]], int]:
    """(piece, score) by id and the id of the unknown piece; control and byte pieces never match text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    ids = range(model.get_piece_size())
    special = lambda i: model.is_control(i) or model.is_byte(i) or model.is_unknown(i)
    pieces = [(f"\x00{i}" if special(i) else model.id_to_piece(i), float(model.get_score(i))) for i in ids]
    return pieces, model.unk_id()


class Counter:
    """Counts pieces of the best segmentation."""

    def __init__(self, pieces: list[tuple[str, float]], unknown: int):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for i, (piece, score) in enumerate(pieces):
            if piece and i != unknown and piece not in self.automaton:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((score for _, score in pieces), default=0.0) - UNKNOWN_PENALTY
        self.known: dict[str, int] = {}

    def word(self, word: str) -> int:
        """Pieces of one word: the best score wins, ties go to the earliest starting last piece.

        ``best[i]`` is (score, pieces, whether the last is unknown) of the first i
        characters. Pieces ending at i are tried from the longest on, which are
        those that start first.
        """
        best: list[tuple[float, int, bool]] = [(0.0, 0, False)]
        single = [False] * len(word)
        ending: list[list[tuple[int, float]]] = [[] for _ in word]
        for end, (length, score) in self.automaton.iter(word) if self.automaton.kind else ():
            ending[end].append((length, score))
            single[end] |= length == 1
        for end, found in enumerate(ending):
            top: tuple[float, int, bool] | None = None
            found.sort(reverse=True)
            if not single[end]:
                found.append((1, self.unknown))
            for length, score in found:
                before = best[end + 1 - length]
                total = before[0] + score
                if top is None or total > top[0]:
                    is_unknown = length == 1 and not single[end]
                    top = total, before[1] + (not (is_unknown and before[2])), is_unknown
            best.append(top)
        return best[-1][1]

    def text(self, text: str) -> int:
        """Pieces of a whole text; each word is a space mark and what follows up to the next one."""
        known, total = self.known, 0
        marked = text.replace(" ", SPACE)
        for word in marked.removeprefix(SPACE).split(SPACE) if text else ():
            n = known.get(word)
            if n is None:
                n = self.word(SPACE + word)
                if len(word) <= CACHED_CHARS:
                    if len(known) >= CACHED_WORDS:
                        known.clear()
                    known[word] = n
            total += n
        return total


@cache
def _counter(model_path: str) -> Counter:
    return Counter(*unigram_vocabulary(model_path))


def count_tokens(docs: DataFrame, model_path: str) -> DataFrame:
    """Rows (doc_id, n_tokens, n_chars) of all rows of ``docs`` over their whole texts.

    A null text counts 0 tokens and has null characters; an empty one 0 and 0.
    Each space begins a word, and so does the text, so several spaces in a row are
    pieces of their own; other white space is text. Repeated rows and null doc_ids are kept; other
    columns are ignored; no rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(model_path)
        for batch in batches:
            texts = [t.as_py() for t in batch.column(1)]
            counts = [counter.text(t or "") for t in texts]
            chars = [None if t is None else len(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(chars, pa.int64())], ["doc_id", "n_tokens", "n_chars"])

    tuned(docs.sparkSession)
    return pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(
        run, "doc_id long, n_tokens long, n_chars long"
    )
