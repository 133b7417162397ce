"""Flat text blocks of a page with the features of each block and its neighbours."""

from __future__ import annotations

import html as html_lib
import re
from typing import NamedTuple

# Element names of HTML.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p "
    "pre search section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
DROPPED = frozenset("script style template textarea iframe canvas audio video head title".split())
CHROME = frozenset("nav footer aside form menu dialog button noscript fieldset search label".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that end an open paragraph, and those of which a new one ends an open one of the same kind.
_ENDS_P = BLOCK - {"head", "body", "html", "title", "option", "optgroup", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "legend"}
_ENDS_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "a": ("a",)}
#: Words in class, id and role that speak against and for the main text.
AGAINST = frozenset(
    "ad ads adv advert advertisement adverts adsense banner billboard bookmark breadcrumb breadcrumbs callout chat combx "
    "comment comments community consent contentinfo complementary cookie cookies copyright cta disclaimer discussion "
    "disqus feedback footer footnav form gdpr header hidden legal login masthead menu modal nav navbar navigation "
    "newsletter notice notices notification outbrain pager pagination popup promo promotion promoted rail reader recommend "
    "recommended register related replies reply respond response responses rss search share sharing shoutbox sidebar side "
    "signup skip skyscraper social sponsor sponsored subscribe subscription taboola tags toolbar tooltip topbar trending "
    "widget widgets alert".split()
)
FOR = frozenset("article content entry main post story text body".split())
#: Words that words for the main text beside them do not outweigh, and that hold for articles inside.
STRONG = frozenset("comment comments ad ads related".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>")
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]*))?")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Block(NamedTuple):
    """A text block: its text, words, words inside links, and what it stands in."""

    text: str
    words: int
    linked: int
    heading: bool
    chrome: bool
    against: bool
    article: bool
    label: bool


class _Open(NamedTuple):
    """An open element and what it and its ancestors say.

    ``mark``: number of the nearest mark against it; ``hard``: the nearest one
    that an article inside does not lift; ``within``: the nearest one around it,
    lifted or not; -1 for none.
    """

    name: str
    link: bool
    heading: bool
    chrome: bool
    article: bool
    label: bool
    main: bool
    mark: int
    hard: int
    within: int


_ROOT = _Open("", False, False, False, False, False, False, -1, -1, -1)


class _Mark(NamedTuple):
    """An element that its class, id or role speak against, or that is hidden."""

    hidden: bool
    strong: bool
    above: int
    around: int


def _same_places(page: str) -> str:
    """The page in lower case, every character where it was; one that becomes several (U+0130) stays."""
    lower = page.lower()
    if len(lower) == len(page):
        return lower
    return "".join([low if len(low := c.lower()) == 1 else c for c in page])


def _attributes(raw: str) -> dict[str, str]:
    found = {}
    for name, value in _ATTR.findall(raw):
        found.setdefault(name.lower(), html_lib.unescape(value.strip("\"'") if value[:1] in "\"'" else value))
    return found


def _opened(name: str, raw: str, above: _Open, marks: list[_Mark]) -> _Open:
    attrs = _attributes(raw) if raw.strip(" /") else {}
    said = " ".join(attrs.get(k, "") for k in ("class", "id", "role"))
    parts = {p.lower() for p in _PARTS.findall(said)} if said else set()
    main = name in ("article", "main") or attrs.get("role") in ("main", "article")
    hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true" or bool(_HIDDEN.search(attrs.get("style", "")))
    neutral = name in ("html", "body") or main and above.mark < 0
    strong = bool(parts & STRONG)
    own = hidden or (not neutral and bool(parts & AGAINST) and not (parts & FOR and not strong))
    mark, hard, within = above.hard if main else above.mark, above.hard, above.within
    if own:
        marks.append(_Mark(hidden, strong, above.mark, above.within))
        mark = within = len(marks) - 1
        hard = mark if hidden or strong else hard
    chrome = above.chrome or name in CHROME or (name == "header" and not above.article)
    if main and mark < 0 and not above.chrome:
        chrome = False
    return _Open(
        name, above.link or (name == "a" and "href" in attrs), above.heading or name in HEADINGS, chrome,
        above.article or main or (bool(parts & FOR) and name not in ("html", "body")), above.label or "data-main" in attrs,
        above.main or main, mark, hard, within,
    )


def _against(blocks: list[Block], stood: list[_Open], marks: list[_Mark]) -> list[Block]:
    """The blocks with ``against`` set: whether a mark around them stands.

    A mark of an element that holds most words of the page is lifted if no text
    outside it looks like an article, for strong words if it holds an article
    element too: such an element is the layout of the page. Hidden ones stay.
    """
    count = [[0, 0, 0] for _ in marks]  # words; those that look like an article; those in article elements
    page = good = 0
    for block, where in zip(blocks, stood):
        fine = block.words * (where.article and not where.chrome and where.mark < 0)
        page, good = page + block.words, good + fine
        if where.within >= 0:
            for i, n in enumerate((block.words, fine, block.words * where.main)):
                count[where.within][i] += n
    for at in range(len(marks) - 1, -1, -1):
        if (around := marks[at].around) >= 0:
            for i in range(3):
                count[around][i] += count[at][i]
    stands: list[bool] = []
    for mark, (words, fine, inner) in zip(marks, count):
        lifted = not mark.hidden and 2 * words > page and fine == good and (inner > 0 or not mark.strong)
        stands.append(not lifted or (mark.above >= 0 and stands[mark.above]))
    return [b._replace(against=w.mark >= 0 and stands[w.mark]) for b, w in zip(blocks, stood)]


def text_blocks(page: str) -> list[Block]:
    """All text blocks in page order, without scripts, styles, comments and hidden heads.

    A block ends at every block-level tag. Character references are decoded,
    white space inside a block becomes one space. Markup may be broken in any way.
    """
    blocks: list[Block] = []
    stood: list[_Open] = []
    marks: list[_Mark] = []
    stack: list[_Open] = [_ROOT]
    open_names: dict[str, int] = {}
    parts: list[tuple[str, bool]] = []
    where = _ROOT

    def flush() -> None:
        if not parts:
            return
        text = " ".join("".join(t for t, _ in parts).split())
        if text:
            linked = len("".join(t if link else " " for t, link in parts).split())
            blocks.append(Block(text, text.count(" ") + 1, linked, where.heading, where.chrome, False, where.article, where.label))
            stood.append(where)
        parts.clear()

    def close(depth: int) -> None:
        for gone in stack[depth:]:
            open_names[gone.name] -= 1
        del stack[depth:]

    def nearest(names: tuple[str, ...], inside: frozenset[str]) -> int:
        """Depth of the nearest open element of these names, not looking past the elements of ``inside``."""
        if any(open_names.get(n) for n in names):
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].name in names:
                    return depth
                if stack[depth].name in inside:
                    return 0
        return 0

    at, size, lower = 0, len(page), _same_places(page)
    while at < size:
        left = page.find("<", at)
        if left < 0:
            left = size
        if left > at:
            if not parts:
                where = stack[-1]
            parts.append((html_lib.unescape(page[at:left]), stack[-1].link))
        if left == size:
            break
        if page.startswith("<!--", left):
            end = page.find("-->", left + 4)
            at = size if end < 0 else end + 3
            continue
        if page[left + 1 : left + 2] in ("!", "?"):
            end = page.find(">", left)
            at = size if end < 0 else end + 1
            continue
        tag = _TAG.match(page, left)
        if not tag:
            end = page.find(">", left) if page[left + 1 : left + 2].isalpha() or page[left + 1 : left + 2] == "/" else -1
            if end < 0:
                parts.append(("<", stack[-1].link))
                at = left + 1
            else:
                at = end + 1
            continue
        at = tag.end()
        closing, name, raw = tag[1], tag[2].lower(), tag[3]
        block = name in BLOCK
        if block:
            flush()
        elif name == "br":
            parts.append((" ", stack[-1].link))
        if closing:
            depth = nearest((name,), frozenset() if block else BLOCK)
            if depth:
                close(depth)
            continue
        if name in DROPPED and not raw.endswith("/"):
            end = lower.find(f"</{name}", at)
            end = page.find(">", end) if end >= 0 else -1
            if name == "head":
                body = lower.find("<body", at)
                at = at if end < 0 and body < 0 else end + 1 if end >= 0 and (body < 0 or end < body) else body
            else:
                at = size if end < 0 else end + 1
            continue
        if name in VOID:
            continue
        if name in _ENDS_P and (depth := nearest(("p",), BLOCK - {"p"} - HEADINGS)):
            close(depth)
        if name in _ENDS_SAME and (depth := nearest(_ENDS_SAME[name], BLOCK - {"p", "td", "th", "dt", "dd"} - {*_ENDS_SAME[name]})):
            close(depth)
        stack.append(_opened(name, raw, stack[-1], marks))
        open_names[name] = open_names.get(name, 0) + 1
    flush()
    return _against(blocks, stood, marks)


FEATURES = (
    "words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after",
    "heading", "chrome", "against", "article", "article_page",
)


def features(blocks: list[Block]) -> list[tuple[float, ...]]:
    """The features of every block: own and neighbours' word counts and link densities, and where it stands.

    Beyond the ends of the page there is a block without words and links.
    """
    page = float(any(b.article for b in blocks))
    own = [(float(b.words), b.linked / b.words) for b in blocks]
    around = [(0.0, 0.0), *own, (0.0, 0.0)]
    return [
        (*around[i + 1], *around[i], *around[i + 2], float(b.heading), float(b.chrome), float(b.against), float(b.article), page)
        for i, b in enumerate(blocks)
    ]
