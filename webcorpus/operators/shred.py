"""Shred pages into element rows.

``shred_html`` is the only Python table function of the package: one pass over
a page's tokens with a stack of open elements. Its output is one row per page
with nested arrays, so a page never has to be regrouped. Elements are numbered
in document order and carry their parent and the interval ``pre..last`` of their
subtree, so a page takes space in proportion to its markup, however deep it nests.
"""

from __future__ import annotations

import html as html_std
import re
import sys
from collections import defaultdict
from collections.abc import Iterator, Sequence
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webcorpus.functions.urls import base_url

# workers get this module's code with the task and need no installed package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# How HTML closes elements by itself.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = frozenset(
    "address article aside blockquote center dd div dl dt fieldset footer form h1 h2 h3 h4 h5 h6 "
    "header hr li main nav ol p pre section table tbody td tfoot th thead tr ul".split()
)
# start tag -> (open elements it closes, elements it never looks past)
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, set()),
}
P_BARRIER = {"table", "td", "th", "caption", "button", "object"}
# an end tag does not close through elements of a higher rank
END_RANK = {
    "div": 150, "td": 160, "th": 160, "tr": 170, "thead": 180, "tbody": 180,
    "tfoot": 180, "table": 190, "head": 200, "body": 200, "html": 220,
}

# text, comment, raw element with its attributes and body, tag; a declaration fills no group
TOKEN = re.compile(
    r"([^<]+)|(<!--(?:.*?--|[^>]*)>)|<[!?][^>]*>"
    r"|<(script|style)\b([^>]*)>(.*?)(?:</\3\s*>|\Z)"
    r"""|<(/?)([a-z][^\s/>]*)([^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*)*)>"""
    r"|(<)",
    re.I | re.S,
)
# only delimited references are decoded; "&ampx" stays as it is
ENTITY = re.compile(r"&(?:#\d+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")
# a tag without its brackets, and its name; what plain tags are split at; where other tokens begin
TAG = re.compile(r"""(/?)([a-z][^\s/>]*)([^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*)*)""", re.I)
NAME = re.compile(r"/?[^\s/>]*")
BRACKETS = re.compile("<([^<>]*)>")
SPECIAL = re.compile(r"<(?:[!?]|(?:script|style)\b)", re.I)
COMMENT_MARK = "<!"
#: Characters that are split at once, and somewhat more.
REGION = 4096
ATTR = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")

NODE = pa.struct(
    [(n, pa.int32()) for n in
     ("pre", "last", "parent", "depth", "ord", "sib_pos", "tag_pos", "tag_n",
      "t_lo", "t_hi", "head", "first", "tail", "c0", "c1")]
    + [("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())),
       ("attr_names", pa.list_(pa.string()))]
)
TEXT = pa.struct([("tord", pa.int32()), ("parent", pa.int32()), ("after", pa.int32()),
                  ("after_comment", pa.bool_()), ("seen", pa.int32()), ("text", pa.string())])
COMMENT = pa.struct([("parent", pa.int32()), ("ord", pa.int32()), ("tail", pa.int32())])

NODE_DDL = (
    "pre INT, last INT, parent INT, depth INT, ord INT, sib_pos INT, tag_pos INT, tag_n INT, "
    "t_lo INT, t_hi INT, head INT, first INT, tail INT, c0 INT, c1 INT, tag STRING, "
    "attrs MAP<STRING,STRING>, attr_names ARRAY<STRING>"
)
DOM_DDL = (
    "page_id BIGINT, url STRING, text STRING, "
    f"nodes ARRAY<STRUCT<{NODE_DDL}>>, "
    "texts ARRAY<STRUCT<tord INT, parent INT, after INT, after_comment BOOLEAN, seen INT, text STRING>>, "
    "comments ARRAY<STRUCT<parent INT, ord INT, tail INT>>"
)


def _pop_to(open_names: list[str], height: int, names: set[str], barrier: set[str]) -> int:
    """How many of the first ``height`` open elements stay when every one in ``names`` above the last barrier is closed."""
    for i in range(height - 1, -1, -1):
        if open_names[i] in barrier:
            break
        if open_names[i] in names:
            height = i
    return height


def _end_height(open_names: list[str], name: str) -> int:
    rank = END_RANK.get(name, 100)
    for i in range(len(open_names) - 1, -1, -1):
        if open_names[i] == name:
            return i
        if END_RANK.get(open_names[i], 100) > rank:
            break
    return len(open_names)


def decode(value: str) -> str:
    return ENTITY.sub(lambda m: html_std.unescape(m[0]), value) if "&" in value else value


def _attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    if not raw:
        return out
    for name, dq, sq, bare in ATTR.findall(raw):
        out.setdefault(name.lower(), decode(dq or sq or bare))
    return out


class _Tags:
    """The different tags of some pages, by what stands between their brackets: markup repeats its tags, so each is taken apart once."""

    #: So many are carried on from one lot of pages to the next.
    ROOM = 4096

    def __init__(self) -> None:
        #: What the walk needs to know: (number, name, whether it closes a paragraph, what else it closes, whether it is void); an end tag has the number -1.
        self.kept: dict[str, tuple] = {COMMENT_MARK: (-2, "")}
        self.names: list[str] = []
        self.attrs: list[dict[str, str]] = []

    def opening(self, name: str, attrs: str) -> tuple:
        self.names.append(name)
        self.attrs.append(_attributes(attrs))
        return len(self.names) - 1, name, name in CLOSES_P, IMPLIED_END.get(name), name in VOID

    def read(self, inner: str) -> tuple | None:
        """A tag that ends at its first closing bracket whatever follows; a quote in the name may look further."""
        token = TAG.fullmatch(inner)
        if token is None or any(q in NAME.match(inner)[0] for q in "\"'"):
            return None
        end, name, attrs = token.groups()
        self.kept[inner] = tag = (-1, name.lower()) if end else self.opening(name.lower(), attrs)
        return tag


def _pieces(html: str, tags_read: _Tags) -> Iterator[tuple[list[str], bool]]:
    """Parts of a page: texts and, at every second place, what stands in brackets; and whether the texts are taken as they are.

    What no token but a plain tag can hold is split at its brackets; where that
    gives no tag, and at comments, declarations and raw elements, one token is read.
    ``send`` gets the place of a piece that is no tag.
    """
    at, size, special = 0, len(html), -1
    while at < size:
        if special < at:
            found = SPECIAL.search(html, at)
            special = found.start() if found else size
        if at < special:
            stop = html.find("<", at + REGION)
            stop = special if stop < 0 else min(stop, special)
            pieces = BRACKETS.split(html[at:stop])
            pieces.append("")
            wrong = yield pieces, False
            if wrong is None:
                at = stop
                continue
            # the texts and tags before it were used
            at += sum(map(len, pieces[:wrong])) + 2 * (wrong // 2)
            if wrong % 2 == 0:
                at += pieces[wrong].index("<")
        token = TOKEN.match(html, at)
        at = token.end()
        _, comment, raw, raw_attrs, body, end, name, attrs, lone = token.groups("")
        if name or raw:
            # a sign that no plain tag has keeps the two apart
            inner = f"<{end}{name}{attrs}" if name else f"<{raw}{raw_attrs}"
            if inner not in tags_read.kept:
                tags_read.kept[inner] = (-1, name.lower()) if end else tags_read.opening((name or raw).lower(), attrs or raw_attrs)
            yield ["", inner] if name else ["", inner, body, f"/{raw.lower()}"], True
        elif comment:
            yield ["", COMMENT_MARK], True
        elif lone:
            yield [lone, ""], True


def _shred_columns(html: str, tags_read: _Tags) -> tuple[dict[str, list], dict[str, list], dict[str, list]]:
    """What one pass over a page finds of its elements, texts and comments, a list for each field; ``_completed`` adds the rest."""
    last: list[int] = []
    parents: list[int] = []
    depth: list[int] = []
    ords: list[int] = []
    t_lo: list[int] = []
    t_hi: list[int] = []
    kinds: list[int] = []  # numbers of the elements' tags
    text: list[str] = []
    t_parent: list[int] = []
    t_after: list[int] = []
    t_comment: list[bool] = []
    t_seen: list[int] = []
    c_parent: list[int] = []
    c_ord: list[int] = []
    c_tail: list[int] = []
    stack: list[int] = []
    names: list[str] = []  # of the open elements
    # of the innermost open element, or the page: its number, its children, the last element among them, whether a comment came since
    top, children, after, commented = -1, 0, -1, False
    more = False  # whether text that follows belongs to the last text node
    # how many elements of a tag are open: the stack is searched only for what it holds
    n_open: defaultdict[str, int] = defaultdict(int)
    kept, read = tags_read.kept, tags_read.read
    n = m = level = 0  # elements, texts, open elements

    parts = _pieces(html, tags_read)
    part = next(parts, None)
    while part is not None:
        pieces, raw = part
        wrong = None
        for i in range(0, len(pieces), 2):
            value, inner = pieces[i], pieces[i + 1]
            if value:
                if not raw:
                    if "<" in value:
                        wrong = i
                        value = value[: value.index("<")]
                    if "&" in value:
                        value = decode(value)
                if not value or (top < 0 and not value.strip()):
                    pass
                elif more:
                    text[-1] += value
                else:
                    if commented:
                        c_tail[-1] = m
                    text.append(value)
                    t_parent.append(top)
                    t_after.append(after)
                    t_comment.append(commented)
                    t_seen.append(n)
                    m += 1
                    more = True
                if wrong is not None:
                    break
            if not inner and i + 2 == len(pieces):
                break
            tag = kept.get(inner) or read(inner)
            if tag is None:
                wrong = i + 1
                break
            number, name = tag[0], tag[1]
            if number >= 0:
                _, _, closes_p, implied, void = tag
                height = level
                if closes_p and n_open["p"]:
                    height = _pop_to(names, height, {"p"}, P_BARRIER)
                if implied and any(n_open[t] for t in implied[0]):
                    height = _pop_to(names, height, *implied)
            elif number == -1:
                if not n_open[name]:
                    continue
                height = level - 1 if names[-1] == name else _end_height(names, name)
            else:
                children, commented, more = children + 1, True, False
                c_parent.append(top)
                c_ord.append(children)
                c_tail.append(-1)
                continue
            if height < level:
                while level > height:
                    pre = stack.pop()
                    n_open[names.pop()] -= 1
                    last[pre] = n - 1
                    t_hi[pre] = m
                    level -= 1
                top, children, after, commented, more = parents[pre], ords[pre], pre, False, False
            if number >= 0:
                children += 1
                kinds.append(number)
                parents.append(top)
                depth.append(level)
                ords.append(children)
                last.append(n)
                t_lo.append(m)
                t_hi.append(m)
                commented = more = False
                if void:
                    after = n
                else:
                    stack.append(n)
                    names.append(name)
                    n_open[name] += 1
                    level += 1
                    top, children, after = n, 0, -1
                n += 1
        try:
            part = parts.send(wrong)
        except StopIteration:
            part = None
    for pre in stack:
        last[pre], t_hi[pre] = n - 1, m

    nodes = {"last": last, "parent": parents, "depth": depth, "ord": ords, "t_lo": t_lo, "t_hi": t_hi, "kind": kinds}
    texts = {"parent": t_parent, "after": t_after, "after_comment": t_comment, "seen": t_seen, "text": text}
    return nodes, texts, {"parent": c_parent, "ord": c_ord, "tail": c_tail}


def _ranks(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place how many places up to it hold the same key, and how many in all."""
    order = np.argsort(keys, kind="stable")
    new = np.flatnonzero(np.diff(keys[order], prepend=-1))
    sizes = np.diff(new, append=len(keys))
    rank, size = np.empty(len(keys), np.int32), np.empty(len(keys), np.int32)
    rank[order] = np.arange(len(keys)) - np.repeat(new, sizes) + 1
    size[order] = np.repeat(sizes, sizes)
    return rank, size


def _completed(pages: list[tuple[dict[str, list], ...]], tags_read: _Tags) -> tuple[list[dict[str, Sequence]], list[np.ndarray]]:
    """Element, text and comment columns of several pages, one page after the other, and how many rows of each a page has.

    What follows from the other fields of a page (positions among siblings, the texts of an element) is made for all pages at once.
    """
    counts = [np.array([len(page[table]["parent"]) for page in pages]) for table in range(3)]
    nodes, texts, comments = ({name: list(chain.from_iterable(page[table][name] for page in pages)) for name in pages[0][table]} for table in range(3))
    for table in (nodes, texts, comments):
        for name in table.keys() - {"text", "after_comment"}:  # NumPy takes a list of numbers much faster than Arrow
            table[name] = np.array(table[name], np.int32)
    n_nodes, n_texts, _ = counts
    starts, t_starts = np.cumsum(n_nodes) - n_nodes, np.cumsum(n_texts) - n_texts
    base, t_base = np.repeat(starts, n_nodes), np.repeat(t_starts, n_nodes)
    nodes["pre"] = (np.arange(len(base)) - base).astype(np.int32)

    different, which = np.unique(nodes.pop("kind"), return_inverse=True)
    named = pa.array([tags_read.names[k] for k in different], pa.string())
    made = _attribute_arrays([tags_read.attrs[k] for k in different]) | {"tag": named}
    nodes |= {name: column.take(pa.array(which)) for name, column in made.items()}
    # the siblings of an element have its parent, or stand outside of all elements of its page
    family = np.where(nodes["parent"] < 0, len(base) + np.repeat(np.arange(len(pages)), n_nodes), nodes["parent"] + base)
    nodes["sib_pos"], _ = _ranks(family)
    nodes["tag_pos"], nodes["tag_n"] = _ranks(family * len(named) + named.dictionary_encode().indices.to_numpy()[which])

    texts["tord"] = (np.arange(n_texts.sum()) - np.repeat(t_starts, n_texts)).astype(np.int32)
    texts["after_comment"] = commented = np.array(texts["after_comment"], bool)
    around, inside, behind = np.repeat(starts, n_texts), texts["parent"] >= 0, texts["after"] >= 0
    for name, where, owner in (
        ("head", inside & ~behind & ~commented, "parent"), ("first", inside, "parent"), ("tail", behind & ~commented, "after"),
    ):
        nodes[name] = np.full(len(base), -1, np.int32)
        # of several texts the first one is written last
        nodes[name][(texts[owner] + around)[where][::-1]] = texts["tord"][where][::-1]
    length = np.concatenate([[0], np.cumsum([len(t) for t in texts["text"]], dtype=np.int64)])
    for name, limit in (("c0", "t_lo"), ("c1", "t_hi")):
        nodes[name] = (length[nodes[limit] + t_base] - length[t_base]).astype(np.int32)
    return [nodes, texts, comments], counts


def shred_page(html: str) -> tuple[list[dict], list[dict], list[dict]]:
    """Element, text and comment records of one page."""
    tags_read = _Tags()
    made, _ = _completed([_shred_columns(html, tags_read)], tags_read)
    plain = lambda column: column if isinstance(column, list) else column.tolist()
    nodes, texts, comments = ([dict(zip(c, row)) for row in zip(*map(plain, c.values()))] for c in made)
    for node in nodes:
        node["attrs"] = dict(node["attrs"])
    return nodes, texts, comments


def _attribute_arrays(attrs: list[dict[str, str]]) -> dict[str, pa.Array]:
    """``attrs`` and ``attr_names`` of all elements from flat names and values: a list for each element is slow."""
    offsets = pa.array([0, *accumulate(map(len, attrs))], pa.int32())
    names = pa.array([k for a in attrs for k in a], pa.string())
    values = pa.array([v for a in attrs for v in a.values()], pa.string())
    return {"attrs": pa.MapArray.from_arrays(offsets, names, values), "attr_names": pa.ListArray.from_arrays(offsets, names)}


def _list_array(columns: dict[str, Sequence], counts: np.ndarray, struct: pa.StructType) -> pa.ListArray:
    made = [c if isinstance(c, pa.Array) else pa.array(c, f.type) for f in struct for c in [columns[f.name]]]
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(made, fields=list(struct)))


def _shred_batches(batches: Iterator[pa.RecordBatch], rows: int = 128) -> Iterator[pa.RecordBatch]:
    tags_read = _Tags()
    for whole in batches:
        for start in range(0, whole.num_rows, rows):
            batch = whole.slice(start, rows)
            if len(tags_read.kept) > _Tags.ROOM:
                tags_read = _Tags()
            shredded = [_shred_columns(h or "", tags_read) for h in batch.column("html").to_pylist()]
            made, counts = _completed(shredded, tags_read)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"),
                    batch.column("url"),
                    pa.array(["".join(s[1]["text"]) for s in shredded], pa.string()),
                    *map(_list_array, made, counts, (NODE, TEXT, COMMENT)),
                ],
                names=["page_id", "url", "text", "nodes", "texts", "comments"],
            )


def shred_html(pages: DataFrame) -> DataFrame:
    """``dom``: one row per page with its page text and its element, text and comment arrays."""
    return pages.select(F.col("page_id").cast("bigint"), "url", "html").mapInArrow(_shred_batches, DOM_DDL)


def subtree_text(page_text: Column, c0: Column, c1: Column) -> Column:
    return F.substring(page_text, c0 + 1, c1 - c0)


def nearest_ancestors(pre: Column, levels: int | Column) -> Column:
    """Numbers of at most ``levels`` ancestors of an element of ``nodes``, the nearest first."""
    nodes = F.col("nodes")
    steps = F.least(F.get(nodes, pre)["depth"], F.lit(levels) if isinstance(levels, int) else levels)
    up = lambda found, _: F.array_append(found, F.get(nodes, F.coalesce(F.try_element_at(found, F.lit(-1)), pre))["parent"])
    return F.when(steps > 0, F.aggregate(F.sequence(F.lit(1), steps), F.array().cast("array<int>"), up)).otherwise(F.array().cast("array<int>"))


def elements(dom: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row per element. ``text`` is cut from the page text only where it is used."""
    others = [c for c in (keep or []) if c not in ("page_id", "url")]
    n = F.col("n")
    return dom.select("page_id", "url", *others, "text", "texts", F.explode("nodes").alias("n")).select(
        "page_id",
        "url",
        *others,
        "n.*",
        F.concat(F.lit("e"), n["pre"]).alias("aid"),
        F.try_element_at(n["attrs"], F.lit("class")).alias("cls"),
        F.try_element_at(n["attrs"], F.lit("id")).alias("id_attr"),
        subtree_text(F.col("text"), n["c0"], n["c1"]).alias("text"),
        F.get("texts", n["head"])["text"].alias("own_text"),
    )


def text_nodes(dom: DataFrame) -> DataFrame:
    return dom.select("page_id", F.inline("texts"))


def class_tokens(cls: Column) -> Column:
    """Distinct-preserving white-space split of a class attribute."""
    some = F.filter(F.split(cls, r"(?U)\s+"), lambda t: t != "")
    return F.when(cls.isNotNull(), some).otherwise(F.array().cast("array<string>"))


def dom_base() -> Column:
    """What relative references of a shredded page start from: its base element's reference, else its URL."""
    bases = F.filter("nodes", lambda n: (n["tag"] == "base") & F.map_contains_key(n["attrs"], F.lit("href")))
    return base_url(F.col("url"), F.try_element_at(F.get(bases, 0)["attrs"], F.lit("href")))
