"""URL expressions. Every function maps Columns to a Column and stays in the JVM.

The generic RFC 3986 split is done with one regular expression instead of
``parse_url``, which rejects addresses that contain spaces or stray ``%``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from webcorpus.functions.text import let

# Fixed values.
BLOCKED_PREFIXES = ("javascript:", "mailto:", "tel:", "data:", "#")
DOWNLOAD_EXTENSIONS = ("pdf", "zip", "rar", "7z", "doc", "docx", "xls", "xlsx")
PAGE_KEYS = ("page", "page_num", "pn", "offset", "start")

URL_RE = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(#.*)?$"
SCHEME, AUTHORITY, PATH, QUERY, FRAGMENT = 1, 2, 3, 4, 5
_SEP = "\u0001"


def trim_ws(col: Column) -> Column:
    """Strip leading and trailing Unicode white space."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def url_part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, URL_RE, group)


class Parts:
    """All parts of a URL from one pass of the expression; scheme and authority in lower case."""

    def __init__(self, split: Column) -> None:
        get = lambda i: F.coalesce(F.get(split, i - 1), F.lit(""))
        self.scheme, self.raw_authority = F.lower(get(SCHEME)), get(AUTHORITY)
        self.authority = F.lower(self.raw_authority)
        self.path, self.query, self.fragment = get(PATH), get(QUERY), get(FRAGMENT)


def split_url(url: Column) -> Column:
    return F.split(F.regexp_replace(url, URL_RE, _SEP.join(f"${i}" for i in range(1, 6))), _SEP, -1)


def with_parts(url: Column, use: Callable[[Parts], Column]) -> Column:
    return let(split_url(url), lambda s: use(Parts(s)))


def _question(query: Column) -> Column:
    return F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")


def get_domain(url: Column) -> Column:
    return F.lower(url_part(url, AUTHORITY))


def is_same_domain(url: Column, domain: Column) -> Column:
    return get_domain(url) == F.lower(domain)


def url_path(url: Column) -> Column:
    return url_part(url, PATH)


def is_blocked_href(href: Column) -> Column:
    return F.lower(href).rlike("^(?:" + "|".join(BLOCKED_PREFIXES) + ")")


def _drop_dots(segments: Column) -> Column:
    """Apply ``.`` and ``..`` left to right; popping an empty stack is a no-op."""
    popped = lambda acc: F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
    out = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", popped(acc))
        .when(s == ".", acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    last = F.element_at(segments, -1)
    return F.when(last.isin(".", ".."), F.concat(out, F.array(F.lit("")))).otherwise(out)


def _merge_path(base_path: Column, path: Column) -> Column:
    """Path of a reference whose path is not empty."""

    def relative(parts: Column) -> Column:
        # empty segments inside the merged path would double the slashes
        inner = F.filter(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))), lambda s: s != "")
        return F.when(
            F.size(parts) > 1, F.concat(F.slice(parts, 1, 1), inner, F.slice(parts, -1, 1))
        ).otherwise(parts)

    base = let(
        F.split(base_path, "/", -1),
        lambda b: F.when(F.element_at(b, -1) != "", F.slice(b, F.lit(1), F.size(b) - 1)).otherwise(b),
    )
    segments = F.when(path.startswith("/"), F.split(path, "/", -1)).otherwise(
        let(F.concat(base, F.split(path, "/", -1)), relative)
    )
    merged = let(segments, lambda s: F.array_join(_drop_dots(s), "/"))
    simple = path.startswith("/") & ~path.rlike(r"(^|/)\.\.?(/|$)")
    return F.when(simple, path).otherwise(
        let(merged, lambda m: F.when(m.startswith("/"), m).otherwise(F.concat(F.lit("/"), m)))
    )


def resolve_url(base: Column, href: Column) -> Column:
    """Resolve a reference against a base (RFC 3986, same-scheme references are relative)."""

    def resolved(x: Column) -> Column:
        b, h = Parts(x["b"]), Parts(x["h"])
        tail = F.concat(_question(h.query), h.fragment)
        root = lambda authority: F.concat(b.scheme, F.lit("://"), authority)
        return (
            F.when(F.coalesce(x["base"], F.lit("")) == "", x["href"])
            .when(F.coalesce(x["href"], F.lit("")) == "", x["base"])
            .when((h.scheme != "") & (h.scheme != b.scheme), x["href"])
            .when(h.raw_authority != "", F.concat(root(h.raw_authority), h.path, tail))
            .when(
                h.path == "",
                F.concat(
                    root(b.raw_authority), b.path, F.when(h.query != "", _question(h.query)).otherwise(_question(b.query)), h.fragment
                ),
            )
            .otherwise(F.concat(root(b.raw_authority), _merge_path(b.path, h.path), tail))
        )

    both = F.struct(base.alias("base"), href.alias("href"))
    split = lambda y: F.struct(
        y["base"].alias("base"), y["href"].alias("href"), split_url(y["base"]).alias("b"), split_url(y["href"]).alias("h")
    )
    return let(let(both, split), resolved)


def canonical_url(absolute: Column, keep_query: bool = True) -> Column:
    """Canonical form of an absolute http(s) URL; anything else becomes null."""
    return with_parts(
        absolute,
        lambda p: F.when(
            p.scheme.isin("http", "https") & (p.authority != ""),
            F.concat(
                p.scheme, F.lit("://"), p.authority,
                F.when(p.path == "", F.lit("/")).otherwise(p.path),
                _question(p.query) if keep_query else F.lit(""),
            ),
        ),
    )


def _tidy(href: Column) -> Column:
    return F.regexp_replace(trim_ws(href), r"[\t\r\n]", "")


def base_url(url: Column, reference: Column) -> Column:
    """What the links of a page start from: its base reference made absolute, else its URL."""
    return F.coalesce(F.when(F.trim(reference) != "", resolve_url(url, F.trim(reference))), url)


def normalize_url(href: Column, base: Column | None = None, keep_query: bool = True) -> Column:
    """Absolute, canonical http(s) URL for a raw reference, or null."""
    absolute = lambda c: c if base is None else resolve_url(base, c)
    return let(
        _tidy(href), lambda c: F.when((c != "") & ~is_blocked_href(c), canonical_url(absolute(c), keep_query))
    )


def link_url(href: Column, base: Column) -> Column:
    """Target of a link attribute.

    Link attributes are made absolute before they are normalised, so ``#top``
    and an empty reference point at the page itself.
    """
    return let(resolve_url(base, _tidy(href)), lambda a: F.when(~is_blocked_href(a), canonical_url(a)))


def is_basic_valid(url: Column) -> Column:
    bad = r"\.(?:" + "|".join(DOWNLOAD_EXTENSIONS) + r")$"
    ok = lambda p: p.scheme.isin("http", "https") & (p.raw_authority != "") & ~F.lower(p.path).rlike(bad)
    return F.coalesce(with_parts(url, ok), F.lit(False))


def path_segments(url: Column) -> Column:
    return F.filter(F.split(url_path(url), "/"), lambda s: s != "")


def parent_path(url: Column) -> Column:
    """Path without its last segment; null when there are fewer than two parts."""
    parts = F.split(F.regexp_replace(url_path(url), r"^/+|/+$", ""), "/", -1)
    return let(
        parts,
        lambda p: F.when(F.size(p) >= 2, F.array_join(F.slice(p, F.lit(1), F.size(p) - 1), "/")),
    )


def _form_decode(col: Column) -> Column:
    return F.coalesce(F.try_url_decode(col), F.regexp_replace(col, r"\+", " "))


def _form_encode(col: Column) -> Column:
    return F.replace(F.replace(F.url_encode(col), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def plus_one(digits: Column) -> Column:
    """A decimal number of any length plus one, without leading zeros."""
    number = F.regexp_replace(digits, "^0+(?=.)", "")
    head = F.regexp_replace(number, "9*$", "")
    zeros = F.repeat(F.lit("0"), F.length(number) - F.length(head))
    last = (F.right(head, F.lit(1)).cast("int") + 1).cast("string")
    raised = F.when(head == "", F.lit("1")).otherwise(F.concat(F.substring(head, F.lit(1), F.length(head) - 1), last))
    return F.concat(raised, zeros)


def increment_page_param(url: Column) -> Column:
    """Array of raw next-page URLs, one per numeric paging key in fixed key order."""
    pair = lambda kv: F.struct(
        _form_decode(F.regexp_extract(kv, r"^([^=]*)", 1)).alias("k"),
        _form_decode(F.regexp_extract(kv, r"^[^=]*=?(.*)$", 1)).alias("v"),
    )
    query = url_part(url, QUERY)
    pairs = F.transform(F.filter(F.split(query, "&"), lambda kv: kv != ""), pair)
    # a repeated key keeps its first place and its last value
    last_value = lambda ps: F.transform(
        F.array_distinct(F.transform(ps, lambda p: p["k"])),
        lambda k: F.element_at(F.filter(ps, lambda p: p["k"] == k), -1),
    )

    def bumped(settings: Column) -> Column:
        def rebuilt(key: Column) -> Column:
            new = lambda p: F.when(p["k"] == key, plus_one(p["v"])).otherwise(_form_encode(p["v"]))
            return F.array_join(F.transform(settings, lambda p: F.concat(_form_encode(p["k"]), F.lit("="), new(p))), "&")

        numeric = F.transform(F.filter(settings, lambda p: p["v"].rlike(r"^[0-9]+$")), lambda p: p["k"])
        usable = F.filter(F.array(*[F.lit(k) for k in PAGE_KEYS]), lambda k: F.array_contains(numeric, k))
        head = F.regexp_extract(url, r"^[^?#]*", 0)
        return F.transform(usable, lambda k: F.concat(head, F.lit("?"), rebuilt(k)))

    appended = F.concat(url, F.when(query != "", F.lit("&")).otherwise(F.lit("?")), F.lit("page=2"))
    return let(let(let(pairs, last_value), bumped), lambda c: F.when(F.size(c) > 0, c).otherwise(F.array(appended)))
