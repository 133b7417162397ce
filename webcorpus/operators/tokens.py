"""Flat markup operators: one regular expression splits a page into tokens.

Everything here is a narrow projection inside the JVM. Use these operators when
only tags, attributes or the page text matter; use ``shred`` when the tree does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webcorpus.functions.text import decode_entities, let, strip_text
from webcorpus.functions.urls import base_url

TOKEN_RE = (
    r"(?is)<!--.*?-->|<[!?][^>]*>"
    r"|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\z)"
    r"""|</?[a-z][^>"']*+(?:(?:"[^"]*"|'[^']*')[^>"']*+)*+>"""
    r"|[^<]+|<"
)
RAW_RE = r"(?is)^<(?:script|style)\b"
RAW_BODY_RE = r"(?is)^<(?:script|style)\b[^>]*>(.*?)(?:</(?:script|style)\s*>)?$"
TAG_RE = r"(?s)^</?([A-Za-z][^\s/>]*)"


def tokens_of(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(TOKEN_RE), 0)


def token_kind(tok: Column) -> Column:
    return (
        F.when(tok.startswith("<!--"), "comment")
        .when(tok.rlike(r"^<[!?]"), "declaration")
        .when(tok.rlike(RAW_RE), "raw")
        .when(tok.rlike(r"(?s)^</[A-Za-z].*>$"), "close")
        .when(tok.rlike(r"(?s)^<[A-Za-z].*>$"), "open")
        .otherwise("text")
    )


def tokenize_html(pages: DataFrame) -> DataFrame:
    """(page_id, i, kind, tag, token): lossless, the tokens concatenate to the page."""
    tok = F.col("token")
    return (
        pages.select("page_id", F.posexplode(tokens_of(F.col("html"))).alias("i", "token"))
        .withColumn("kind", token_kind(tok))
        .withColumn(
            "tag",
            F.when(F.col("kind").isin("open", "close", "raw"), F.lower(F.regexp_extract(tok, TAG_RE, 1))),
        )
        .select("page_id", "i", "kind", "tag", "token")
    )


def drop_comments(pages: DataFrame) -> DataFrame:
    """Pages whose markup no longer holds comments."""
    kept = F.filter(tokens_of(F.col("html")), lambda t: ~t.startswith("<!--"))
    return pages.withColumn("html", F.array_join(kept, ""))


def page_text(html: Column) -> Column:
    """Text of a page, script and style text included, entities decoded."""
    piece = (
        lambda t: F.when(~t.startswith("<"), decode_entities(t))
        .when(t.rlike(RAW_RE), F.regexp_extract(t, RAW_BODY_RE, 1))
        .when(F.length(t) == 1, t)
        .otherwise("")
    )
    return F.array_join(F.transform(tokens_of(html), piece), "")


def attribute(tag_token: Column, name: str) -> Column:
    """Value of an attribute in an open-tag token; null when it is absent."""
    other = rf"""(?:[\s/]++(?!{name}[\s=/>])[^\s=>"'/]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"']++))?+)*+"""
    found = rf"""(?is)^<[a-z][^\s/>]*+{other}[\s/]++({name}(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"']++))?+)"""
    value = lambda raw: F.when(
        raw != "", decode_entities(F.regexp_extract(raw, r"""(?s)=\s*["']?(.*?)["']?$""", 1))
    )
    return let(F.regexp_extract(tag_token, found, 1), value)


def anchors(pages: DataFrame) -> DataFrame:
    """(page_id, url, base, ord, href): every ``a[@href]`` in document order.

    ``base`` is what relative references start from: the page's first ``base``
    element with a reference, else its URL.
    """
    with_href = lambda name: lambda t: t.rlike(rf"(?is)^<{name}[\s/].*\bhref\b")
    parts = let(
        tokens_of(F.col("html")),
        lambda tokens: F.struct(
            F.filter(tokens, with_href("a")).alias("anchors"), F.get(F.filter(tokens, with_href("base")), 0).alias("base")
        ),
    )
    return (
        pages.select("page_id", "url", parts.alias("_p"))
        .withColumn("base", base_url(F.col("url"), attribute(F.col("_p.base"), "href")))
        .select("page_id", "url", "base", F.posexplode("_p.anchors").alias("ord", "token"))
        .withColumn("href", attribute(F.col("token"), "href"))
        .filter(F.col("href").isNotNull())
        .select("page_id", "url", "base", "ord", "href")
    )


def anchor_count(html: Column) -> Column:
    return F.size(
        F.filter(tokens_of(html), lambda t: t.rlike(r"(?is)^<a[\s/].*\bhref\b") & attribute(t, "href").isNotNull())
    )


def needs_render(pages: DataFrame, min_text: int = 500) -> DataFrame:
    """Pages with so little text that they were probably drawn by a script."""
    n = F.length(strip_text(page_text(F.col("html"))))
    return pages.select("page_id", "url", n.alias("text_chars")).filter(F.col("text_chars") < min_text)


def page_fingerprint(pages: DataFrame, chars: int = 4000) -> DataFrame:
    """(page_id, url, fingerprint, anchor_count) used to tell whether a page changed."""
    return pages.select(
        "page_id",
        "url",
        F.md5(F.substring(page_text(F.col("html")), 1, chars)).alias("fingerprint"),
        anchor_count(F.col("html")).cast("bigint").alias("anchor_count"),
    )
