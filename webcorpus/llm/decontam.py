"""Benchmark decontamination by pigeonhole edit matching.

A test item with an error budget of k is cut into k + 1 pieces. If a document
holds the item with at most k edits, one piece occurs in it unchanged, near the
place that its offset in the item says. An Aho-Corasick automaton finds the
pieces; Myers' bit-parallel distance decides at these places.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webcorpus.llm.common import numbered, pick, stage, tuned

#: Edits allowed for each code point of an item.
ERROR_RATE = 0.05
#: Shorter items (after normalising) name no source and match nothing.
MIN_CHARS = 20
#: Code points of items that one automaton holds; more items take more passes over the documents.
BLOCK_CHARS = 4_000_000

MATCH_SCHEMA = "doc_id long, item_id long, distance int, start long, stop long"


def normalised(text: str) -> str:
    """Lower case, runs of white space as one space, trimmed."""
    return " ".join(text.lower().split())


class Pattern:
    """Myers' bit vectors of one item."""

    def __init__(self, item_id: int, text: str, budget: int):
        self.item_id, self.text, self.budget = item_id, text, budget
        self.top, self.mask = 1 << (len(text) - 1), (1 << len(text)) - 1

    @cached_property
    def places(self) -> dict[str, int]:
        return self._places(self.text)

    @staticmethod
    def _places(text: str) -> dict[str, int]:
        out: dict[str, int] = {}
        for i, c in enumerate(text):
            out[c] = out.get(c, 0) | 1 << i
        return out

    def _scores(self, places: dict[str, int], text: str, anchored: int) -> Iterator[int]:
        """Distance of the pattern to the best ending at each place of ``text``; anchored: to the whole text so far."""
        up, down, score, mask, top = self.mask, 0, len(self.text), self.mask, self.top
        for c in text:
            eq = places.get(c, 0)
            vertical = eq | down
            across = (((eq & up) + up) ^ up) | eq
            plus = down | (mask & ~(across | up))
            minus = up & across
            if plus & top:
                score += 1
            elif minus & top:
                score -= 1
            plus, minus = plus << 1 | anchored, minus << 1
            up = (minus | ~(vertical | plus)) & mask
            down = plus & vertical & mask
            yield score

    def best(self, text: str) -> tuple[int, int, int] | None:
        """(distance, start, stop) of the leftmost best occurrence within the budget."""
        least, stop = self.budget + 1, 0
        for i, score in enumerate(self._scores(self.places, text, 0), 1):
            if score < least:
                least, stop = score, i
                if not score:
                    break
        if least > self.budget:
            return None
        back = text[max(0, stop - len(self.text) - least) : stop][::-1]
        for i, score in enumerate(self._scores(self._places(self.text[::-1]), back, 1), 1):
            if score == least:
                return least, stop - i, stop
        return least, 0, stop


class Matcher:
    """The pieces of a block of items in one automaton."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        pieces: dict[str, list[tuple[int, int]]] = {}
        self.patterns = []
        for item_id, text in items:
            budget = int(rate * len(text))
            cuts = [len(text) * i // (budget + 1) for i in range(budget + 2)]
            for a, b in zip(cuts, cuts[1:]):
                pieces.setdefault(text[a:b], []).append((len(self.patterns), a))
            self.patterns.append(Pattern(item_id, text, budget))
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def matches(self, raw: str | None) -> Iterator[tuple[int, int, int, int]]:
        """(item_id, distance, start, stop) of the best occurrence of each item in a text."""
        if not raw or not self.patterns:
            return
        text = normalised(raw)
        found: dict[int, list[int]] = {}
        for end, (length, places) in self.automaton.iter(text):
            for item, offset in places:
                found.setdefault(item, []).append(end + 1 - length - offset)
        for item, starts in sorted(found.items()):
            pattern = self.patterns[item]
            best = None
            for a, b in _regions(starts, len(pattern.text), pattern.budget):
                a = max(0, a)
                hit = pattern.best(text[a:b])
                if hit and (best is None or hit[0] < best[0]):
                    best = hit[0], hit[1] + a, hit[2] + a
                    if not hit[0]:
                        break
            if best:
                yield pattern.item_id, *best


def _regions(starts: list[int], length: int, budget: int) -> Iterator[tuple[int, int]]:
    """The stretches of text that an occurrence near one of ``starts`` can lie in, merged where they overlap."""
    at: tuple[int, int] | None = None
    for start in sorted(set(starts)):
        a, b = start - budget, start + length + budget
        if at and a <= at[1]:
            at = at[0], b
        else:
            if at:
                yield at
            at = a, b
    if at:
        yield at


def item_blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS, min_chars: int = MIN_CHARS) -> Iterator[list[tuple[int, str]]]:
    """Normalised items in blocks of about ``block_chars`` code points; equal texts go by the smallest item_id.

    The driver holds one block at a time.
    """
    pattern = r"[\s\p{Z}\x{85}\x1c-\x1f]+"
    items = pick(benchmark, "item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    items = items.select("item_id", F.trim(F.regexp_replace(F.lower("text"), pattern, " ")).alias("text"))
    items = stage(items.groupBy("text").agg(F.min("item_id").alias("item_id")))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = int(total // block_chars) + 1
    for i in range(n):
        block = items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == i).collect() if n > 1 else items.collect()
        texts: dict[str, int] = {}
        for row in sorted(block, key=lambda r: r["item_id"]):
            texts.setdefault(normalised(row["text"]), row["item_id"])
        kept = [(item_id, text) for text, item_id in texts.items() if len(text) >= min_chars]
        if kept:
            yield kept


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """Rows (doc_id, item_id, distance, start, stop): the best occurrence of each item in each document.

    ``start`` and ``stop`` count code points of the normalised text (lower case,
    white space as single spaces). Null and empty texts and items match nothing;
    items that are equal when normalised go by the smallest item_id; repeated
    rows give repeated results; a null doc_id stays null. Without items or
    documents there are no rows. Other columns are ignored.
    """
    spark = tuned(docs.sparkSession)
    texts = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    out = spark.createDataFrame([], MATCH_SCHEMA)
    for items in item_blocks(benchmark):
        out = out.union(texts.mapInArrow(_matching(items, rate), MATCH_SCHEMA))
    return out


def _matching(items: list[tuple[int, str]], rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(items, rate)
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        for batch in batches:
            rows = [
                (doc_id, *hit)
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1))
                for hit in matcher.matches(text.as_py())
            ]
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "item_id", "distance", "start", "stop"]
            )

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """The documents that hold no item within its error budget, with all their columns.

    A filter inside the scan, once for each block of items: nothing is shuffled.
    Null and empty texts stay.
    """
    tuned(docs.sparkSession)
    inner, columns = numbered(docs, "text")
    for items in item_blocks(benchmark):
        inner = inner.mapInArrow(_clean(items, rate, len(columns)), inner.schema)
    return inner.drop("text").toDF(*columns)


def _clean(items: list[tuple[int, str]], rate: float, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(items, rate)
        for batch in batches:
            keep = [next(matcher.matches(text.as_py()), None) is None for text in batch.column(at)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run
