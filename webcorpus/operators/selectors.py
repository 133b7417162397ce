"""Selectors: a small XPath subset parsed and evaluated with array expressions.

A selector column is parsed into an array of steps. Matching folds the steps
over the element array of a page, so evaluation is a projection of the page row
and shuffles nothing; only the (small) selector table is joined to the pages.

Subset: steps ``/`` ``//`` ``.//``; a tag or ``*``; predicates ``[@a]``,
``[@a='v']``, ``[contains(@a,'v')]``, ``[contains(text(),'v')]``,
``[contains(normalize-space(text()),'v')]`` joined by ``and``/``or``; one
integer position directly after the tag; suffix ``/@attr`` or ``/text()``.
Anything else counts as "does not match" and is reported by ``parse_selectors``.
"""

from __future__ import annotations

import string
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webcorpus.functions.text import let, normalize_text
from webcorpus.operators.shred import subtree_text
from webcorpus.session import cut_lineage, join_small

_QUOTED = r"""'[^']*'|"[^"]*\""""
SUFFIX_RE = r"/(?:text\(\)|@[\w:\-]+)$"
STEP_RE = rf"""(?://?|^)(?:\*|[A-Za-z][\w\-]*)(?:\[(?:[^\]'"]|{_QUOTED})*\])*"""
PRED_RE = rf"""\[((?:[^\]'"]|{_QUOTED})*)\]"""
AHEAD = rf"""(?=(?:[^'"]|{_QUOTED})*$)"""
_ATOMS = {
    "attr_eq": r"""^@([\w:\-]+)\s*=\s*(?:'([^']*)'|"([^"]*)")$""",
    "attr": r"""^@([\w:\-]+)()()$""",
    "attr_has": r"""^contains\(\s*@([\w:\-]+)\s*,\s*(?:'([^']*)'|"([^"]*)")\s*\)$""",
    "words_has": r"""^contains\(\s*(normalize-space)\(\s*text\(\)\s*\)\s*,\s*(?:'([^']*)'|"([^"]*)")\s*\)$""",
    "text_has": r"""^contains\(\s*(text)\(\)\s*,\s*(?:'([^']*)'|"([^"]*)")\s*\)$""",
}

INTS = "array<int>"
#: Selectors that one pass applies to every page; more selectors take more passes.
UNKEYED_BLOCK = 1_000


def split_suffix(xpath: Column) -> tuple[Column, Column]:
    """(path without extraction suffix, suffix: '', 'text()' or '@name')."""
    suffix = F.regexp_replace(F.regexp_extract(xpath, SUFFIX_RE, 0), "^/", "")
    return F.regexp_replace(xpath, SUFFIX_RE, ""), suffix


def _atom(raw: Column) -> Column:
    """Kind, name and value of a condition; the kind is found once, and by its first characters where they tell."""
    kind = None
    for label, pattern in _ATOMS.items():
        hit = raw.startswith("@" if pattern.startswith("^@") else "contains(") & raw.rlike(pattern)
        kind = F.when(hit, label) if kind is None else kind.when(hit, label)

    def parts(known: Column) -> Column:
        name = value = None
        for label, pattern in _ATOMS.items():
            got = lambda i, pattern=pattern: F.regexp_extract(raw, pattern, i)
            is_it, both = known == label, F.concat(got(2), got(3))
            name = F.when(is_it, got(1)) if name is None else name.when(is_it, got(1))
            value = F.when(is_it, both) if value is None else value.when(is_it, both)
        return F.struct(known.alias("kind"), name.alias("name"), value.alias("value"))

    return let(kind, parts)


def _predicate(raw: Column) -> Column:
    """A predicate as an OR of ANDs of atoms."""
    either = F.split(F.trim(raw), r"\s+or\s+" + AHEAD)
    return F.transform(either, lambda c: F.transform(F.split(F.trim(c), r"\s+and\s+" + AHEAD), lambda a: _atom(F.trim(a))))


def _lower(name: Column) -> Column:
    """A tag name, which is ASCII, in small letters; ``lower`` maps the cases of all languages."""
    return F.translate(name, string.ascii_uppercase, string.ascii_lowercase)


def _step(raw: Column) -> Column:
    def taken(preds: Column) -> Column:
        def built(first_is_pos: Column) -> Column:
            rest = F.when(first_is_pos, F.slice(preds, F.lit(2), F.size(preds))).otherwise(preds)
            return F.struct(
                raw.startswith("//").alias("deep"),
                _lower(F.regexp_extract(raw, r"^/{0,2}(\*|[A-Za-z][\w\-]*)", 1)).alias("tag"),
                F.when(first_is_pos, F.trim(F.get(preds, 0)).cast("int")).alias("pos"),
                F.transform(rest, _predicate).alias("preds"),
            )

        return let(F.coalesce(F.get(preds, 0).rlike(r"^\s*\d+\s*$"), F.lit(False)), built)

    return let(F.regexp_extract_all(raw, F.lit(PRED_RE), 1), taken)


def parse_path(path: Column) -> Column:
    """Struct (rel, steps) of a path without suffix; null when it is outside the subset."""

    def without_dot(path: Column) -> Column:
        body = F.regexp_replace(path, r"^\.(?=/|$)", "")
        body = F.when(path.rlike(r"^\./(?!/)"), F.regexp_replace(body, "^/", "")).otherwise(body)
        return F.when(path.startswith("."), body).otherwise(path)

    def checked(path: Column, body: Column, raw: Column) -> Column:
        whole = (F.array_join(raw, "") == body) & ((F.size(raw) > 0) | (path == "."))
        known = lambda steps: F.forall(
            steps,
            lambda s: F.forall(s["preds"], lambda d: F.forall(d, lambda c: F.forall(c, lambda a: a["kind"].isNotNull()))),
        )
        return F.when(
            whole,
            let(
                F.transform(raw, _step),
                lambda steps: F.when(known(steps), F.struct((~path.startswith("/")).alias("rel"), steps.alias("steps"))),
            ),
        )

    # each part is used several times, and often is itself made by expressions
    steps = lambda path, body: let(F.regexp_extract_all(body, F.lit(STEP_RE), 0), lambda raw: checked(path, body, raw))
    return let(path, lambda p: let(without_dot(p), lambda body: steps(p, body)))


def parse_selectors(selectors: DataFrame, column: str = "xpath") -> DataFrame:
    """Add ``path`` (parsed steps), ``suffix`` and ``error`` to a selector table."""
    base, suffix = split_suffix(F.col(column))
    out = selectors.withColumns({"path": parse_path(base), "suffix": suffix})
    return out.withColumn("error", F.when(F.col("path").isNull(), F.concat(F.lit("unsupported selector: "), F.col(column))))


def _passes(n: Column, s: Column, texts: Column) -> Column:
    first = F.coalesce(F.get(texts, n["first"])["text"], F.lit(""))

    def atom(a: Column) -> Column:
        value = F.try_element_at(n["attrs"], a["name"])
        return F.coalesce(
            F.when(a["kind"] == "attr", value.isNotNull())
            .when(a["kind"] == "attr_eq", value == a["value"])
            .when(a["kind"] == "attr_has", F.contains(value, a["value"]))
            .when(a["kind"] == "words_has", F.contains(normalize_text(first), a["value"]))
            .otherwise(F.contains(first, a["value"])),
            F.lit(False),
        )

    at = F.when(s["tag"] == "*", n["sib_pos"]).otherwise(n["tag_pos"])
    return (
        ((s["tag"] == "*") | (n["tag"] == s["tag"]))
        & (s["pos"].isNull() | (at == s["pos"]))
        & F.forall(s["preds"], lambda d: F.exists(d, lambda c: F.forall(c, atom)))
    )


def _below(nodes: Column, acc: Column) -> Column:
    """Numbers of all proper descendants of the elements in ``acc``."""
    last = lambda c: F.get(nodes, c)["last"]
    return F.flatten(
        F.transform(acc, lambda c: F.when(last(c) > c, F.sequence(c + 1, last(c))).otherwise(F.array().cast(INTS)))
    )


def _children(nodes: Column, acc: Column) -> Column:
    """Numbers of the elements whose parent is in ``acc``; -1 stands for the document."""
    inside = lambda c: F.when(c < 0, nodes).otherwise(F.slice(nodes, c + 2, F.get(nodes, c)["last"] - c))
    own = lambda c: F.transform(F.filter(inside(c), lambda n: n["parent"] == c), lambda n: n["pre"])
    return F.flatten(F.transform(acc, own))


def root_context(nodes: Column) -> Column:
    """Where a relative path without container starts: the ``html`` element, else the document.

    A page without ``html`` tags has an implied root, whose children are the page's own roots.
    """
    return F.when(F.get(nodes, 0)["tag"] == "html", F.lit(0)).otherwise(F.lit(-1))


def match(path: Column, nodes: Column, texts: Column, context: Column | None = None, scope: Column | None = None) -> Column:
    """Document-ordered numbers of the elements that ``path`` selects; never null.

    ``context`` is the element a relative path starts from (default:
    ``root_context``); absolute paths start from the document. ``scope`` may narrow the
    elements that are looked at, e.g. to the subtree of the context.
    """
    scope = nodes if scope is None else scope
    context = root_context(nodes) if context is None else context

    def advance(acc: Column, s: Column) -> Column:
        first = F.get(acc, 0)

        def reached(found: Column) -> Column:
            numbers = lambda some: F.transform(some, lambda n: n["pre"])
            inside = lambda last: F.filter(found, lambda n: (n["pre"] > first) & (n["pre"] <= last))
            return (
                # what a single element is asked for needs no sets
                F.when(~s["deep"] & (F.size(acc) == 1), numbers(F.filter(found, lambda n: n["parent"] == first)))
                .when(~s["deep"], F.array_intersect(numbers(found), _children(nodes, acc)))
                .when(first == -1, numbers(found))
                .when(F.size(acc) == 1, numbers(let(F.get(nodes, first)["last"], inside)))
                .otherwise(F.array_intersect(numbers(found), _below(nodes, acc)))
            )

        return let(F.filter(scope, lambda n: _passes(n, s, texts)), reached)

    def run(p: Column) -> Column:
        start = F.array(F.when(p["rel"], context).otherwise(F.lit(-1)).cast("int"))
        return F.aggregate(p["steps"], start, advance)

    return F.coalesce(let(path, run), F.array().cast(INTS))


def values_of(matched: Column, suffix: Column, text: Column, nodes: Column, texts: Column) -> Column:
    """Raw string results: element text, text nodes or attribute values."""
    node = lambda p: F.get(nodes, p)
    full = F.transform(matched, lambda p: subtree_text(text, node(p)["c0"], node(p)["c1"]))
    own = F.flatten(
        F.transform(
            matched,
            lambda p: F.transform(
                F.filter(
                    F.slice(texts, node(p)["t_lo"] + 1, node(p)["t_hi"] - node(p)["t_lo"]), lambda t: t["parent"] == p
                ),
                lambda t: t["text"],
            ),
        )
    )
    attrs = F.array_compact(
        F.transform(matched, lambda p: F.try_element_at(node(p)["attrs"], F.regexp_replace(suffix, "^@", "")))
    )
    return F.when(suffix == "", full).when(suffix == "text()", own).otherwise(attrs)


def each_selector(
    pages: DataFrame, selectors: DataFrame, keep: list[str], template: str | None, evaluate: Callable[[Callable[[str], Column]], Column]
) -> DataFrame:
    """Rows (keep..., selector columns, evaluate's fields): an array of structs for each page and selector, exploded.

    With ``template`` both tables share that key and each page meets the selectors of
    its template. Without it every selector applies to every page: the selectors
    travel as an array that a scalar subquery reads once, a block of
    ``UNKEYED_BLOCK`` at a time, and are evaluated inside the page row, so that no
    page is copied. ``evaluate`` gets a function from names to columns.
    """
    names = [c for c in selectors.columns if c != template]
    if template is not None:
        joined = join_small(pages, selectors, [template], "page_id")
        found = joined.select(*keep, *names, evaluate(F.col).alias("_found"))
        return found.select(*keep, *names, F.inline("_found"))
    selectors = cut_lineage(selectors)
    blocks = selectors.count() // UNKEYED_BLOCK + 1

    def one(s: Column) -> Column:
        get = lambda name: s[name] if name in names else F.col(name)
        return F.transform(evaluate(get), lambda x: F.struct(s.alias("s"), x.alias("x")))

    out = None
    for i in range(blocks):
        block = selectors.filter(F.pmod(F.xxhash64(F.to_json(F.struct(*names))), F.lit(blocks)) == i)
        packed = block.agg(F.collect_list(F.struct(*names)).alias("s")).scalar()
        found = pages.withColumn("_selectors", packed).select(*keep, F.explode(F.flatten(F.transform("_selectors", one))).alias("_f"))
        found = found.select(*keep, *[F.col(f"_f.s.{n}").alias(n) for n in names], "_f.x.*")
        out = found if out is None else out.unionAll(found)
    return out


def match_selectors(
    dom: DataFrame, selectors: DataFrame, template: str | None = None, keep: Sequence[str] = ()
) -> DataFrame:
    """(page_id, url, selector columns..., pre, tag, value) for every match.

    ``selectors`` needs ``xpath``; with ``template`` both tables share that key;
    ``keep`` names further columns of ``dom`` to carry.
    """
    names = [c for c in selectors.columns if c != template]
    nodes, texts = F.col("nodes"), F.col("texts")

    def evaluate(get: Callable[[str], Column]) -> Column:
        one = lambda p: F.struct(
            p.alias("pre"),
            F.get(nodes, p)["tag"].alias("tag"),
            F.get(values_of(F.array(p), get("suffix"), F.col("text"), nodes, texts), 0).alias("value"),
        )
        return F.transform(match(get("path"), nodes, texts), one)

    extra = [template] if template else []
    found = each_selector(dom, parse_selectors(selectors), ["page_id", "url", *keep, *extra], template, evaluate)
    return found.select("page_id", "url", *keep, *extra, *names, "pre", "tag", "value")


def test_unique(dom: DataFrame, selectors: DataFrame, template: str | None = None) -> DataFrame:
    """(page_id, selector columns..., n, is_unique): does a selector match exactly one element?"""
    names = selectors.columns
    count = lambda get: F.array(F.struct(F.size(match(get("path"), F.col("nodes"), F.col("texts"))).alias("n")))
    keep = ["page_id", template] if template else ["page_id"]
    found = each_selector(dom, parse_selectors(selectors), keep, template, count)
    return found.select("page_id", *names, "n", (F.col("n") == 1).alias("is_unique"))
