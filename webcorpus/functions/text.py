"""Text, token and value expressions shared by several operators."""

from __future__ import annotations

import json
from collections.abc import Callable
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

# Shapes of generated identifiers; each is tested from the first character.
RANDOM_TOKEN_PATTERNS = (
    r"^[a-z]{2,4}-[a-zA-Z0-9]{4,}$",
    r"^[a-f0-9]{8,}$",
    r"^_?[a-zA-Z]+_[a-zA-Z0-9]{4,}$",
    r"^__[\w]+-[\w]+$",
    r"^[a-zA-Z0-9]{20,}$",
    r"^[0-9a-f]{8}-[0-9a-f]{4}-",
    r"^\d+$",
)
# Words that mark a long text field, and rights notices.
LONG_TEXT_WORDS = ("content", "article", "body", "正文", "内容")
RIGHTS_NOTICES = ("未经许可", "请勿转载", "版权所有", "copyright", "all rights reserved")
# Value shapes used when a selector is repaired from a sample.
CURRENCY_RE = r"^[\$\€\¥\£\₹]\s*\d+"
DECIMAL_RE = r"^\d+\.\d{2}"
EMAIL_RE = r"^[\w.+-]+@[\w-]+\.[\w.]+"
URL_START_RE = r"^(?:https?://|/)"

# Named references of the flat (regex) path; the shredder knows all of HTML5.
#: Named references of HTML 4, from the standard library's table, and the apostrophe of XML.
NAMED = {**{name: chr(code) for name, code in name2codepoint.items()}, "apos": "'"}
REFERENCE = r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, also inside lambdas."""
    return F.get(F.transform(F.array(value), use), 0)


def normalize_text(col: Column) -> Column:
    """Collapse white-space runs to one space and trim."""
    return F.trim(F.regexp_replace(col, r"(?U)\s+", " "))


def strip_text(col: Column) -> Column:
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def _decode_one(ref: Column) -> Column:
    """The text of one reference: U+FFFD for numbers that are no character, unknown names as they are."""
    hexed = ref.rlike("^&#[xX]")
    number = F.regexp_replace(ref, "^&#[xX]?0*|;$", "")
    code = F.when(F.length(number) <= 7, F.when(hexed, F.conv(number, 16, 10)).otherwise(number)).try_cast("int")
    fine = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    # a number that is no character never reaches the decoder
    point = F.when(fine, code).otherwise(F.lit(0xFFFD))
    as_char = F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")
    names = F.from_json(F.lit(json.dumps(NAMED)), "map<string,string>")
    named = F.coalesce(F.try_element_at(names, F.regexp_replace(ref, "[&;]", "")), ref)
    return F.when(ref.startswith("&#"), as_char).otherwise(named)


def _decode_all(col: Column) -> Column:
    between = F.split(col, REFERENCE, -1)
    found = F.transform(F.regexp_extract_all(col, F.lit(REFERENCE), 0), _decode_one)
    return F.array_join(F.zip_with(between, found, lambda text, char: F.concat(text, F.coalesce(char, F.lit("")))), "")


def decode_entities(col: Column) -> Column:
    """Decode decimal, hexadecimal and named references of any length in one pass."""
    return let(col, lambda c: F.when(c.contains("&"), _decode_all(c)).otherwise(c))


def element_text(text: Column, max_chars: int = 100, ellipsis: bool = True) -> Column:
    t = strip_text(text)
    cut = F.substring(t, 1, max_chars)
    if ellipsis:
        cut = F.when(F.length(t) > max_chars, F.concat(cut, F.lit("..."))).otherwise(cut)
    return cut


def is_random_token(col: Column) -> Column:
    return col.rlike("(?U)" + "|".join(f"(?:{p})" for p in RANDOM_TOKEN_PATTERNS))


def is_long_text_field(name: Column, description: Column) -> Column:
    return F.lower(F.concat_ws(" ", name, description)).rlike("|".join(LONG_TEXT_WORDS))


def is_low_quality(text: Column) -> Column:
    t = F.lower(strip_text(text))
    return (t == "") | t.rlike("|".join(RIGHTS_NOTICES))


def is_similar(a: Column, b: Column) -> Column:
    """Substring either way, or nearly equal when compared position by position."""

    def close(a: Column, b: Column) -> Column:
        shorter = F.least(F.length(a), F.length(b))
        same = F.aggregate(
            F.when(shorter > 0, F.sequence(F.lit(1), shorter)).otherwise(F.array().cast("array<int>")),
            F.lit(0),
            lambda acc, i: acc + F.when(F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1)), 1).otherwise(0),
        )
        return (F.abs(F.length(a) - F.length(b)) <= 3) & (same >= shorter - 2)

    # every position looks at both: they are not made again for each
    return let(a, lambda x: let(b, lambda y: F.contains(x, y) | F.contains(y, x) | close(x, y)))


def infer_pattern(sample: Column) -> Column:
    """Name of the value shape of a sample: currency, decimal, url, email or null."""
    return (
        F.when(sample.rlike("(?U)" + CURRENCY_RE), "currency")
        .when(sample.rlike("(?U)" + DECIMAL_RE), "decimal")
        .when(sample.rlike(URL_START_RE), "url")
        .when(sample.rlike("(?U)" + EMAIL_RE), "email")
    )


def matches_pattern(text: Column, kind: Column) -> Column:
    return (
        F.when(kind == "currency", text.rlike("(?U)" + CURRENCY_RE))
        .when(kind == "decimal", text.rlike("(?U)" + DECIMAL_RE))
        .when(kind == "url", text.rlike(URL_START_RE))
        .when(kind == "email", text.rlike("(?U)" + EMAIL_RE))
        .otherwise(False)
    )
