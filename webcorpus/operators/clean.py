"""Page cleaning on the nested element table.

A cleaning step never moves rows: it is a projection that shrinks ``alive`` (the
numbers of the surviving elements) and ``talive`` (the surviving text nodes).
``render_html`` writes the survivors back as markup, and shredding that again
gives the renumbered tree. Set operations on integer arrays keep every step
linear in the page.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webcorpus.functions.text import normalize_text, strip_text
from webcorpus.operators.intervals import holding, outermost
from webcorpus.operators.shred import VOID as _VOID
from webcorpus.operators.shred import class_tokens, shred_html

VOID = tuple(sorted(_VOID))

# Fixed values.
NOISE_TAGS = ("script", "style", "noscript", "svg", "iframe")
CHROME_TAGS = ("nav", "footer", "header")
KEEP_EMPTY = ("img", "input", "br", "hr", "meta", "link", "html", "body", "head")
MAX_HTML_CHARS = 30_000

INTS = "array<int>"
Predicate = Callable[[Column], Column]


def _upto(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast(INTS))


def start_cleaning(dom: DataFrame) -> DataFrame:
    """Add ``alive`` and ``talive`` when the table does not have them yet."""
    if "alive" in dom.columns:
        return dom
    return dom.withColumns({"alive": _upto(F.size("nodes")), "talive": _upto(F.size("texts"))})


def attr(node: Column, name: str) -> Column:
    return F.try_element_at(node["attrs"], F.lit(name))


def _node(pre: Column) -> Column:
    return F.get(F.col("nodes"), pre)


def _text(tord: Column) -> Column:
    return F.get(F.col("texts"), tord)


def _removable(node: Column) -> Column:
    """Everything but a single root element."""
    return (node["pre"] > 0) | (node["last"] < F.size("nodes") - 1)


def _range(lo: Column, hi: Column) -> Column:
    return F.when(hi > lo, F.sequence(lo, hi - 1)).otherwise(F.array().cast(INTS))


def _drop_sets(roots: Column, keep_tails: bool) -> tuple[Column, Column]:
    """Numbers of the elements and text nodes that vanish with the given subtrees."""
    gone = F.flatten(F.transform(roots, lambda p: F.sequence(p, _node(p)["last"])))

    def texts(p: Column) -> Column:
        inside = _range(_node(p)["t_lo"], _node(p)["t_hi"])
        return inside if keep_tails else F.array_append(inside, _node(p)["tail"])

    return gone, F.flatten(F.transform(roots, texts))


def drop_subtrees(dom: DataFrame, predicate: Predicate, keep_tails: bool = False) -> DataFrame:
    """Remove the matching elements with their descendants.

    By default the text that directly follows a removed element goes with it.
    """
    dom = start_cleaning(dom).withColumn(
        "_roots", F.filter("alive", lambda p: F.coalesce(predicate(_node(p)) & _removable(_node(p)), F.lit(False)))
    )
    gone, gone_texts = _drop_sets(F.col("_roots"), keep_tails)
    return dom.withColumns(
        {"alive": F.array_except("alive", gone), "talive": F.array_except("talive", gone_texts)}
    ).drop("_roots")


def drop_noise_tags(dom: DataFrame, keep_tails: bool = False) -> DataFrame:
    return drop_subtrees(
        dom,
        lambda n: n["tag"].isin(*NOISE_TAGS) | ((n["tag"] == "link") & (attr(n, "rel") == "stylesheet")),
        keep_tails,
    )


def drop_hidden(dom: DataFrame, keep_tails: bool = False) -> DataFrame:
    def hidden(n: Column) -> Column:
        style = F.coalesce(attr(n, "style"), F.lit(""))
        return (
            style.contains("display:none")
            | style.contains("display: none")
            | (F.coalesce(attr(n, "aria-hidden"), F.lit("")) == "true")
            | attr(n, "hidden").isNotNull()
        )

    return drop_subtrees(dom, hidden, keep_tails)


def alive_text() -> Column:
    """Text that is left on the page, in document order."""
    return F.array_join(F.transform("talive", lambda t: _text(t)["text"]), "")


def drop_chrome(dom: DataFrame, min_text: int = 500, keep_tails: bool = False) -> DataFrame:
    """Remove nav, then footer, then header; a step that leaves too little text is undone."""
    dom = start_cleaning(dom)
    for tag in CHROME_TAGS:
        before = dom.withColumns({"_alive": F.col("alive"), "_talive": F.col("talive")})
        after = drop_subtrees(before, lambda n, tag=tag: n["tag"] == tag, keep_tails)
        after = after.withColumn("_ok", F.length(strip_text(alive_text())) >= min_text)
        dom = after.withColumns(
            {
                "alive": F.when(F.col("_ok"), F.col("alive")).otherwise(F.col("_alive")),
                "talive": F.when(F.col("_ok"), F.col("talive")).otherwise(F.col("_talive")),
            }
        ).drop("_alive", "_talive", "_ok")
    return dom


def drop_comment_nodes(dom: DataFrame, keep_tails: bool = False) -> DataFrame:
    """Remove comments, and by default the text that directly follows each of them."""
    dom = start_cleaning(dom)
    if not keep_tails:
        # a comment inside a removed subtree has no surviving tail, so no test is needed
        dom = dom.withColumn(
            "talive", F.array_except("talive", F.transform("comments", lambda c: c["tail"]))
        )
    return dom.withColumn("comments", F.slice("comments", 1, 0))


def drop_empty(dom: DataFrame, keep_tails: bool = False) -> DataFrame:
    """Remove elements that hold nothing, as a fixpoint.

    An element survives exactly when its subtree has a reason to stay: a tag
    that is kept when empty, or text of its own. With tail dropping only text
    before the first child counts, because the removal of the last child takes
    all later text with it. So one upward closure replaces the iteration.
    """
    dom = start_cleaning(dom)
    has_text = F.filter("talive", lambda t: strip_text(_text(t)["text"]) != "")
    if not keep_tails:
        has_text = F.filter(has_text, lambda t: (_text(t)["after"] < 0) & ~_text(t)["after_comment"])
    owners = F.filter(F.transform(has_text, lambda t: _text(t)["parent"]), lambda p: p >= 0)
    kept_tags = F.filter("alive", lambda p: _node(p)["tag"].isin(*KEEP_EMPTY) | ~_removable(_node(p)))
    dom = dom.withColumn("_why", F.array_distinct(F.concat(owners, kept_tags)))
    dom = dom.withColumn("_gone", F.array_except("alive", holding(F.col("nodes.last"), "_why")))
    _, gone_texts = _drop_sets(outermost(F.col("nodes.last"), "_gone"), keep_tails)
    return dom.withColumns(
        {"alive": F.array_except("alive", "_gone"), "talive": F.array_except("talive", gone_texts)}
    ).drop("_why", "_gone")


def sanitize_attrs(dom: DataFrame, max_chars: int = 100) -> DataFrame:
    """Drop ``style``, blank inline SVG sources, shorten long values."""

    def fix(name: Column, value: Column) -> Column:
        value = F.when((name == "src") & value.startswith("data:image/svg+xml"), F.lit("")).otherwise(value)
        return F.when(
            F.length(value) > max_chars, F.concat(F.substring(value, 1, max_chars), F.lit("..."))
        ).otherwise(value)

    def clean(n: Column) -> Column:
        attrs = F.transform_values(F.map_filter(n["attrs"], lambda k, v: k != "style"), fix)
        names = F.filter(n["attr_names"], lambda k: k != "style")
        return n.withField("attrs", attrs).withField("attr_names", names)

    return dom.withColumn("nodes", F.transform("nodes", clean))


def _escape(col: Column) -> Column:
    out = F.replace(F.replace(F.replace(col, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.when(col.rlike("[&<>]"), out).otherwise(col)


def _event(key: Column, rank: Column, piece: Column, place: Column | None = None) -> Column:
    place = F.lit(0) if place is None else place
    return F.struct(
        key.cast("int").alias("key"), rank.cast("int").alias("rank"), place.cast("int").alias("place"), piece.alias("piece")
    )


def markup(annotate: bool = False, notes: bool = False) -> Column:
    """The surviving tree as HTML text.

    Opening tags, texts and closing tags are placed on one axis, the number of
    elements and texts that start before them, and sorted.
    """

    def attributes(n: Column) -> Column:
        quoted = lambda k: F.concat(
            F.lit(" "), k, F.lit('="'),
            F.replace(F.replace(F.try_element_at(n["attrs"], k), F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;")),
            F.lit('"'),
        )
        return F.array_join(F.transform(n["attr_names"], quoted), "")

    def opening(p: Column, i: Column) -> Column:
        n = _node(p)
        aid = F.concat(F.lit(' data-aid="e'), i, F.lit('"')) if annotate else F.lit("")
        return _event(2 * (p + n["t_lo"]), F.lit(0), F.concat(F.lit("<"), n["tag"], attributes(n), aid, F.lit(">")))

    def close_key(n: Column) -> Column:
        return 2 * (n["last"] + 1 + n["t_hi"]) - 1

    def closing(p: Column) -> Column:
        n = _node(p)
        return _event(close_key(n), -2 * n["depth"], F.concat(F.lit("</"), n["tag"], F.lit(">")))

    def text(t: Column) -> Column:
        x = _text(t)
        raw = F.coalesce(_node(x["parent"])["tag"].isin("script", "style"), F.lit(False))
        return _event(2 * (t + x["seen"]), F.lit(0), F.when(raw, x["text"]).otherwise(_escape(x["text"])))

    parts = [
        F.transform("alive", opening),
        F.transform(F.filter("alive", lambda p: ~_node(p)["tag"].isin(*VOID)), closing),
        F.transform("talive", text),
    ]
    if notes:
        parts.append(
            F.transform(
                F.coalesce("notes", F.array().cast("array<struct<parent:int,first:int,n:int>>")),
                lambda x: _event(
                    close_key(_node(x["parent"])),
                    -2 * _node(x["parent"])["depth"] - 1,
                    F.concat(F.lit("<!-- truncated "), x["n"], F.lit(" items -->")),
                    x["first"],
                ),
            )
        )
    return F.array_join(F.transform(F.sort_array(F.concat(*parts)), lambda e: e["piece"]), "")


def render_html(dom: DataFrame, annotate: bool = True) -> DataFrame:
    """(page_id, url, html), every element numbered by ``data-aid`` when annotating."""
    dom = start_cleaning(dom)
    return dom.select("page_id", "url", markup(annotate).alias("html"))


def alive_nodes(dom: DataFrame) -> DataFrame:
    """One row per surviving element, without texts."""
    return start_cleaning(dom).select("page_id", F.inline(F.transform("alive", _node))).withColumn(
        "cls", F.try_element_at("attrs", F.lit("class"))
    )


def repeating_groups(dom: DataFrame, min_members: int = 3) -> DataFrame:
    """Sibling groups of the same tag and class string: (page_id, parent, tag, cls, n)."""
    return (
        alive_nodes(dom)
        .groupBy("page_id", "parent", "tag", F.coalesce("cls", F.lit("")).alias("cls"))
        .agg(F.count("*").alias("n"), F.min("pre").alias("first"))
        .filter((F.col("n") >= min_members) & (F.col("parent") >= 0))
    )


def fence(col: Column) -> Column:
    """The same value, but filters above are not copied below it.

    Pushing a filter through a chain of array projections would inline the
    whole chain once per reference; a non-deterministic guard prevents that.
    """
    return F.when(F.rand() >= 0, col)


def truncate_repeats(dom: DataFrame, keep: int = 3, max_html: int = MAX_HTML_CHARS) -> DataFrame:
    """(page_id, url, html) shortened where the markup exceeds ``max_html``.

    Members of a repeating group beyond ``keep`` go, with a comment that counts
    them; markup that is still too long is cut. Sorting the elements by group
    puts a member next to the one ``keep`` places before it, so ranks need no
    grouping.
    """
    dom = start_cleaning(dom).withColumn("html", fence(markup()))
    member = lambda p: F.struct(
        _node(p)["parent"].alias("parent"),
        _node(p)["tag"].alias("tag"),
        F.coalesce(attr(_node(p), "class"), F.lit("")).alias("cls"),
        p.alias("pre"),
    )
    same = lambda a, b: (a["parent"] == b["parent"]) & (a["tag"] == b["tag"]) & (a["cls"] == b["cls"])
    groups = F.sort_array(F.transform(F.filter("alive", lambda p: _node(p)["parent"] >= 0), member))
    dom = dom.withColumn("_groups", F.when(F.length("html") > max_html, groups).otherwise(F.slice(groups, 1, 0)))
    ahead = lambda i, k: F.get(F.col("_groups"), i - k)
    marked = F.transform(
        "_groups",
        lambda x, i: F.struct(
            x.alias("x"),
            F.coalesce((i >= keep) & same(ahead(i, keep), x), F.lit(False)).alias("extra"),
            F.coalesce((i > keep) & same(ahead(i, keep + 1), x), F.lit(False)).alias("later"),
            ahead(i, keep)["pre"].alias("first"),
        ),
    )
    dom = dom.withColumn("_extra", F.filter(marked, lambda m: m["extra"]))
    notes = F.transform(
        F.filter("_extra", lambda m: ~m["later"]),
        lambda m: F.struct(
            m["x"]["parent"].alias("parent"),
            m["first"].alias("first"),
            F.size(F.filter("_extra", lambda o: same(o["x"], m["x"]))).alias("n"),
        ),
    )
    dom = dom.withColumns({"_roots": F.transform("_extra", lambda m: m["x"]["pre"]), "notes": F.sort_array(notes)})
    gone, gone_texts = _drop_sets(F.col("_roots"), keep_tails=False)
    dom = dom.withColumns(
        {"alive": F.array_except("alive", gone), "talive": F.array_except("talive", gone_texts)}
    ).withColumn("notes", F.filter("notes", lambda x: F.array_contains("alive", x["parent"])))
    short = F.when(F.length("html") > max_html, F.substring(markup(notes=True), 1, max_html)).otherwise(F.col("html"))
    return dom.select("page_id", "url", fence(short).alias("html"))


def clean_html(pages: DataFrame, min_text: int = 500, keep_tails: bool = False) -> DataFrame:
    """Pages reduced to what analysis needs: (page_id, url, html)."""
    dom = shred_html(pages)
    dom = drop_noise_tags(dom, keep_tails)
    dom = drop_hidden(dom, keep_tails)
    dom = drop_chrome(dom, min_text, keep_tails)
    dom = drop_comment_nodes(dom, keep_tails)
    dom = drop_empty(dom, keep_tails)
    return truncate_repeats(sanitize_attrs(dom))


def resolve_aid(refs: DataFrame, elems: DataFrame) -> DataFrame:
    """References (page_id, aid, ...) joined with the element they name; unknown ones drop out."""
    return refs.join(elems, ["page_id", "aid"])


def text_content(elems: DataFrame) -> DataFrame:
    return elems.select("page_id", "pre", "tag", normalize_text(F.col("text")).alias("text"))


def similar_siblings(targets: DataFrame, elems: DataFrame) -> DataFrame:
    """(page_id, pre, sib_pre): siblings of each target with the same tag and a shared class token.

    The target counts as its own sibling; elements without a class go together.
    Targets are the few elements under analysis; statistics over *all* elements
    use the factored form in ``stability`` and never list pairs.
    """
    tok = lambda c: F.when(
        F.coalesce(F.col(c), F.lit("")) == "", F.array(F.lit(""))
    ).otherwise(class_tokens(F.col(c)))
    one = elems.select("page_id", "pre", "parent", "tag", tok("cls").alias("tokens"))
    mine = targets.select("page_id", "pre").distinct().join(one, ["page_id", "pre"])
    theirs = one.select("page_id", F.col("pre").alias("sib_pre"), "parent", "tag", F.explode("tokens").alias("token"))
    return (
        mine.withColumn("token", F.explode("tokens"))
        .join(theirs, ["page_id", "parent", "tag", "token"])
        .filter("parent >= 0")
        .select("page_id", "pre", "sib_pre")
        .distinct()
    )
