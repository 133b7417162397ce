"""Language identification by compression.

Every language has a zstandard dictionary of raw content: whole texts of that
language. A text is compressed with each dictionary; the smallest result names
the language, and a narrow margin rejects it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webcorpus.llm.common import pick, tuned

#: Bytes of raw content for each language; whole texts are taken while they begin below this.
DICTIONARY_BYTES = 131_072
#: Different texts drawn for each language, or more where these are short; the draw is by the hash of the text.
DRAWN_TEXTS = 800
#: A text is compressed in stretches of this many bytes, so that the dictionary counts in all of it.
STRETCH_BYTES = 4_096
#: Relative margin between the two smallest results below which a prediction is rejected.
MIN_MARGIN = 0.005
LEVEL = 6


#: What Python counts as part of a word without being a letter or a digit: fractions, raised digits, number letters.
_NUMBERS = frozenset(c for c in map(chr, range(0x80, 0x20000)) if c.isnumeric() and not c.isalpha() and not c.isdecimal())
_BLANKED = str.maketrans(dict.fromkeys(_NUMBERS, " "))
# without the numbers: a class of hundreds of single signs is tried sign by sign at every letter
_NO_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    """The words of a text in lower case with single spaces; no signs and digits."""
    low = text.lower()
    if not low.isascii() and not _NUMBERS.isdisjoint(low):
        low = low.translate(_BLANKED)
    return _NO_LETTERS.sub(" ", low).strip().encode("utf-8", "replace")


def dictionaries(texts: DataFrame, size: int = DICTIONARY_BYTES, drawn: int = DRAWN_TEXTS) -> dict[str, bytes]:
    """Raw content by language from rows (text, lang); a bounded sample of labelled rows.

    Different texts and their bytes are counted for each language by hashes of the
    texts; the scan thins them by hash to about ``drawn`` a language, or to about four
    times ``size`` bytes where that takes more, and only the thinned rows are ordered and
    cut. The driver receives twice ``size`` bytes and a text at most for each language,
    and leaves out texts that look mislabelled. The most frequent language comes
    first; that decides ties.
    """
    known = texts.where("lang IS NOT NULL AND text IS NOT NULL AND length(trim(text)) > 0")
    drawn_by = F.shiftrightunsigned(F.xxhash64("text"), 11)
    different = known.groupBy("lang", drawn_by.alias("h")).agg(F.count("*").alias("n"), F.max(F.octet_length("text")).cast("long").alias("size"))
    found = different.groupBy("lang").agg(F.sum("n"), F.count("*"), F.sum("size")).collect()
    counts = {r[0]: r[1] for r in found}
    if not counts:
        return {}
    share = F.create_map(*[x for lang, _, n, length in found for x in (F.lit(lang), F.lit(min(1.0, max(drawn / n, 4 * size / length))))])
    thin = known.where(drawn_by < share[F.col("lang")] * F.lit(float(1 << 53)))
    thin = thin.groupBy("lang", drawn_by.alias("h")).agg(F.first("text").alias("text"))  # copies count once
    before = Window.partitionBy("lang").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    taken = thin.withColumn("before", F.coalesce(F.sum(F.octet_length("text")).over(before), F.lit(0)))
    rows = taken.where(F.col("before") < 2 * size).select("lang", "h", F.substring("text", 1, size).alias("text")).collect()
    content = _content(_agreed([(r[0], letters(r[2])) for r in sorted(rows, key=lambda r: (r[1], r[0]))]), size)
    return {lang: content[lang] for lang in sorted(content, key=lambda lang: (-counts[lang], lang))}


def _content(texts: list[tuple[str, bytes]], size: int) -> dict[str, bytes]:
    """Texts one after the other by language, while they begin below ``size``."""
    out: dict[str, bytes] = {}
    for lang, text in texts:
        if len(out.get(lang, b"")) < size:
            out[lang] = out.get(lang, b"") + text + b"\n"
    return out


def _agreed(texts: list[tuple[str, bytes]]) -> list[tuple[str, bytes]]:
    """The texts without those whose language the dictionaries of the other half of the texts deny: mislabelled ones.

    A language of which half or more is denied keeps all its texts: it has too few to judge by.
    """
    halves = texts[::2], texts[1::2]
    kept = []
    for own, other in (halves, halves[::-1]):
        content = _content(other, DICTIONARY_BYTES)
        judge = Compressor(content)
        for lang, text in own:
            sizes = dict(zip(judge.languages, judge.sizes(text)))
            if lang not in sizes or sizes[lang] <= min(sizes.values()):
                kept.append((lang, text))
    before, after = Counter(lang for lang, _ in texts), Counter(lang for lang, _ in kept)
    few = {lang for lang, n in before.items() if 2 * after[lang] <= n}
    return [x for x in kept if x[0] not in few] + [x for x in texts if x[0] in few]


class Compressor:
    """One prepared dictionary for each language."""

    def __init__(self, content: dict[str, bytes]):
        import zstandard

        self.languages = list(content)
        self.by = []
        for lang in self.languages:
            known = zstandard.ZstdCompressionDict(content[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(level=LEVEL)
            self.by.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_checksum=False, write_content_size=False, write_dict_id=False))

    def sizes(self, raw: bytes) -> list[int]:
        """Compressed bytes of the whole text by language."""
        parts = [raw[i : i + STRETCH_BYTES] for i in range(0, len(raw), STRETCH_BYTES)]
        return [sum(len(c.compress(part)) for part in parts) for c in self.by]

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected); ``und`` for null and for texts without letters."""
        raw = letters(text or "")
        if not self.by or not raw:
            return "und", 0.0, True
        sizes = self.sizes(raw)
        order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
        best = sizes[order[0]]
        second = sizes[order[1]] if len(order) > 1 else max(best, len(raw))
        margin = (second - best) / second if second else 0.0
        return self.languages[order[0]], margin, margin < MIN_MARGIN


def identify(docs: DataFrame, content: dict[str, bytes]) -> DataFrame:
    """Rows (doc_id, lang_pred, score, rejected) for every row of ``docs`` from its whole text.

    ``score`` is the relative margin between the two smallest sizes, from 0 to 1;
    ``rejected`` marks margins below ``MIN_MARGIN``. Null, empty and letterless
    texts give ``und``, score 0, rejected, and so does everything if no language
    was learned. Ties go to the language that comes first in ``content``. Repeated rows and null
    doc_ids are kept; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = Compressor(content)
        for batch in batches:
            rows = [compressor.predict(text.as_py()) for text in batch.column(1)]
            lang, score, rejected = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                ["doc_id", "lang_pred", "score", "rejected"],
            )

    tuned(docs.sparkSession)
    return pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(
        run, "doc_id long, lang_pred string, score double, rejected boolean"
    )
