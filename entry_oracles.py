"""DuckDB statements that recompute the registered queries on the same tables.

``dom`` rebuilds the element table in SQL with a recursive walk over the tokens,
so that tree queries are checked against a second, independent shredder.
"""

from __future__ import annotations


def _list(words: str) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words.split()) + "]"


RAW = "|".join(rf"<{t}\b[^>]*>.*?(?:</{t}\s*>|\z)" for t in ("script", "style"))
TOKENS = (
    r"(?is)<!--.*?-->|<[!?][^>]*>|" + RAW
    + r"""|</?[a-z][^>"'']*(?:(?:"[^"]*"|''[^'']*'')[^>"'']*)*>|[^<]+|<"""
)
VOID = _list("area base br col embed hr img input link meta param source track wbr")
CLOSES_P = _list(
    "address article aside blockquote center dd div dl dt fieldset footer form h1 h2 h3 h4 h5 h6 "
    "header hr li main nav ol p pre section table tbody td tfoot th thead tr ul"
)
P_BARRIER = _list("table td th caption button object")


def decode(col: str) -> str:
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "),
                       ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        col = f"replace({col}, '{name}', '{char}')"
    return col


def attr(tok: str, name: str) -> str:
    body = rf"""[\s/]{name}\s*=\s*"([^"]*)\""""
    return f"""CASE WHEN regexp_matches({tok}, '(?is){body}') THEN {decode(f"regexp_extract({tok}, '(?is){body}', 1)")} END"""


def cls_tokens(col: str) -> str:
    return f"list_filter(string_split_regex(coalesce({col}, ''), '\\s+'), lambda t: t <> '')"


def tokens(src: str = "pages") -> str:
    """CTE ``tok(page_id, i, t, kind, tag)``; i counts from 1."""
    return f"""
tok AS (
  SELECT page_id, i, t,
    CASE WHEN t LIKE '<!--%' THEN 'comment'
         WHEN regexp_matches(t, '^<[!?]') THEN 'declaration'
         WHEN regexp_matches(t, '(?is)^<(script|style)\\b') THEN 'raw'
         WHEN regexp_matches(t, '(?s)^</[A-Za-z].*>$') THEN 'close'
         WHEN regexp_matches(t, '(?s)^<[A-Za-z].*>$') THEN 'open'
         ELSE 'text' END AS kind,
    CASE WHEN regexp_matches(t, '(?s)^</?[A-Za-z]') AND t LIKE '%>'
         THEN lower(regexp_extract(t, '^</?([A-Za-z][^\\s/>]*)', 1)) END AS tag
  FROM (SELECT page_id, unnest(ts) AS t, generate_subscripts(ts, 1) AS i
        FROM (SELECT page_id, regexp_extract_all(html, '{TOKENS}') AS ts FROM {src}))
)"""


def _height(stack: str, names: str, barrier: str) -> str:
    """Stack height after an implied end: see the rules in the shredder."""
    last_bar = (f"coalesce(list_max(list_transform({stack}, lambda x, k: "
                f"CASE WHEN list_contains({barrier}, x.tag) THEN k ELSE 0 END)), 0)")
    first = (f"list_min(list_filter(list_transform({stack}, lambda x, k: "
             f"CASE WHEN k > {last_bar} AND list_contains({names}, x.tag) THEN k END), lambda k: k IS NOT NULL))")
    return f"coalesce({first} - 1, len({stack}))"


def dom(src: str = "pages", texts: bool = True) -> str:
    """CTE list (start it with WITH RECURSIVE): tok, walk, el, tx.

    el(page_id, i, pre, parent, tag, t, anc, depth, last, sib_pos, tag_pos, tag_n, cls, id_attr, text)
    tx(page_id, i, parent, anc, piece)
    """
    rank = ("CASE x.tag WHEN 'div' THEN 150 WHEN 'td' THEN 160 WHEN 'th' THEN 160 WHEN 'tr' THEN 170 "
            "WHEN 'thead' THEN 180 WHEN 'tbody' THEN 180 WHEN 'tfoot' THEN 180 WHEN 'table' THEN 190 "
            "WHEN 'head' THEN 200 WHEN 'body' THEN 200 WHEN 'html' THEN 220 ELSE 100 END")
    own_rank = rank.replace("x.tag", "k.tag")
    pos = "list_max(list_transform(w.stack, lambda x, j: CASE WHEN x.tag = k.tag THEN j ELSE 0 END))"
    text_cte = f""",
tx AS (
  SELECT page_id, i, CASE WHEN kind = 'raw' THEN pre ELSE anc[-1] END AS parent,
         CASE WHEN kind = 'raw' THEN list_append(anc, pre) ELSE anc END AS anc,
         CASE WHEN kind = 'raw' THEN regexp_extract(t, '(?is)^<(?:script|style)\\b[^>]*>(.*?)(?:</(?:script|style)\\s*>)?$', 1)
              ELSE {decode('t')} END AS piece
  FROM walk JOIN tok USING (page_id, i) WHERE kind IN ('raw', 'text') AND (kind = 'raw' OR len(anc) > 0 OR trim(t) <> '')
),
el_text AS (
  SELECT page_id, pre, string_agg(piece, '' ORDER BY i) AS text
  FROM (SELECT page_id, unnest(anc) AS pre, i, piece FROM tx) GROUP BY ALL
)""" if texts else ""
    return tokens(src) + f""",
tokx AS (
  SELECT *, CASE WHEN list_contains({CLOSES_P}, tag) THEN ['p'] ELSE []::VARCHAR[] END AS c1,
    CASE WHEN tag = 'li' THEN ['li'] WHEN tag IN ('dt', 'dd') THEN ['dt', 'dd']
         WHEN tag = 'tr' THEN ['tr', 'td', 'th'] WHEN tag IN ('td', 'th') THEN ['td', 'th']
         WHEN tag IN ('tbody', 'thead', 'tfoot') THEN ['thead', 'tbody', 'tfoot', 'tr', 'td', 'th']
         WHEN tag = 'option' THEN ['option'] WHEN tag = 'body' THEN ['head'] ELSE []::VARCHAR[] END AS c2,
    CASE WHEN tag = 'li' THEN ['ul', 'ol'] WHEN tag IN ('dt', 'dd') THEN ['dl'] WHEN tag = 'tr' THEN ['table']
         WHEN tag IN ('td', 'th') THEN ['table', 'tr'] WHEN tag IN ('tbody', 'thead', 'tfoot') THEN ['table']
         WHEN tag = 'option' THEN ['select'] ELSE []::VARCHAR[] END AS b2
  FROM tok
),
walk AS (
  SELECT DISTINCT page_id, 0::BIGINT AS i, []::STRUCT(pre INT, tag VARCHAR)[] AS stack, 0 AS n, NULL::INT AS pre, []::INT[] AS anc
  FROM tok
  UNION ALL
  SELECT page_id, i, 
    CASE WHEN kind = 'open' AND NOT list_contains({VOID}, tag) THEN list_append(base, {{'pre': n0, 'tag': tag}}) ELSE base END,
    CASE WHEN kind IN ('open', 'raw') THEN n0 + 1 ELSE n0 END,
    CASE WHEN kind IN ('open', 'raw') THEN n0 END,
    list_transform(base, lambda x: x.pre)
  FROM (
    SELECT page_id, i, kind, tag, n0,
      CASE WHEN kind IN ('open', 'raw') THEN s1[1:{_height('s1', 'c2', 'b2')}]
           WHEN kind = 'close' AND p > 0 AND len(list_filter(s1[p + 1:], lambda x: {rank} > own)) = 0 THEN s1[1:p - 1]
           ELSE s1 END AS base
    FROM (
      SELECT k.page_id, k.i, k.kind, k.tag, k.c2, k.b2, w.n AS n0, coalesce({pos}, 0) AS p, {own_rank} AS own,
        CASE WHEN k.kind IN ('open', 'raw') THEN w.stack[1:{_height('w.stack', 'k.c1', P_BARRIER)}] ELSE w.stack END AS s1
      FROM walk w JOIN tokx k ON k.page_id = w.page_id AND k.i = w.i + 1))
){text_cte},
el0 AS (
  SELECT page_id, i, pre, coalesce(anc[-1], -1) AS parent, tag, t, anc, len(anc) AS depth
  FROM walk JOIN tok USING (page_id, i) WHERE pre IS NOT NULL
),
el_last AS (
  SELECT page_id, a AS pre, max(pre) AS last FROM (SELECT page_id, pre, unnest(list_append(anc, pre)) AS a FROM el0) GROUP BY ALL
),
el AS (
  SELECT el0.*, last, {attr('t', 'class')} AS cls, {attr('t', 'id')} AS id_attr,
    row_number() OVER (PARTITION BY page_id, parent ORDER BY pre) AS sib_pos,
    row_number() OVER (PARTITION BY page_id, parent, tag ORDER BY pre) AS tag_pos,
    count(*) OVER (PARTITION BY page_id, parent, tag) AS tag_n
    {", coalesce(text, '') AS text" if texts else ""}
  FROM el0 JOIN el_last USING (page_id, pre) {"LEFT JOIN el_text USING (page_id, pre)" if texts else ""}
)"""


# ---- shared pieces -------------------------------------------------------

from entry_corpus import LIST_BASE, LIST_PAGES_SQL, ORDER_PAGES_SQL  # noqa: E402

URL_RE = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def part(url: str, g: int) -> str:
    return f"regexp_extract({url}, '{URL_RE}', {g})"


def canon(url: str, query: bool = True) -> str:
    q = f"CASE WHEN {part(url, 4)} <> '' THEN '?' || {part(url, 4)} ELSE '' END" if query else "''"
    return (f"(lower({part(url, 1)}) || '://' || lower({part(url, 2)}) || "
            f"CASE WHEN {part(url, 3)} = '' THEN '/' ELSE {part(url, 3)} END || {q})")


def rooted(base: str, href: str) -> str:
    """Absolute form of a root-relative reference, the only kind in these pages."""
    return f"({part(base, 1)} || '://' || {part(base, 2)} || {href})"


def with_src(src: str, texts: bool = True) -> str:
    return f"WITH RECURSIVE src AS ({src}), " + dom("src", texts)


PAGES = "SELECT * FROM pages"
DOM = "WITH RECURSIVE " + dom()
ANCHORS = "WITH " + tokens() + f""", a AS (
  SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS ord, {attr('t', 'href')} AS href
  FROM tok WHERE kind = 'open' AND tag = 'a' AND t LIKE '%href=%')"""


def anchors_of(src: str) -> str:
    return f"WITH src AS ({src}), " + tokens("src") + f""", a AS (
  SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS ord, {attr('t', 'href')} AS href
  FROM tok WHERE kind = 'open' AND tag = 'a' AND t LIKE '%href=%')"""


# text nodes with the child they follow: adjacent pieces are one node
TEXT_NODES = """,
cm AS (SELECT page_id, i, anc[-1] AS parent FROM walk JOIN tok USING (page_id, i) WHERE kind = 'comment'),
ev AS (SELECT page_id, parent, i, pre AS el, false AS is_comment FROM el
       UNION ALL SELECT page_id, parent, i, NULL, true FROM cm),
tn0 AS (
  SELECT tx.page_id, tx.i, tx.parent, tx.anc, tx.piece, ev.el, coalesce(ev.is_comment, false) AS after_comment, ev.i AS ei
  FROM (SELECT * FROM tx WHERE piece <> '') tx ASOF LEFT JOIN ev ON tx.page_id = ev.page_id AND tx.parent = ev.parent AND tx.i > ev.i
),
tn AS (
  SELECT page_id, min(i) AS i, parent, any_value(anc) AS anc, string_agg(piece, '' ORDER BY i) AS piece,
         any_value(el) AS el, any_value(after_comment) AS after_comment
  FROM tn0 GROUP BY page_id, parent, ei
)"""


def left_over(base: str, roots: str, keep_tails: bool = False, comments: bool = False) -> str:
    """Elements and text that stay when the ``roots`` subtrees go. ``roots``: SQL condition on el."""
    tail = "false" if keep_tails else "EXISTS (SELECT 1 FROM r WHERE r.page_id = tn.page_id AND r.pre = tn.el AND NOT tn.after_comment)"
    return base + TEXT_NODES + f""",
r AS (SELECT page_id, pre, last FROM el WHERE ({roots}) AND pre > 0),
ge AS (SELECT DISTINCT page_id, unnest(range(pre, last + 1)) AS pre FROM r),
le AS (SELECT page_id, count(*) AS n_elements FROM el ANTI JOIN ge USING (page_id, pre) GROUP BY 1),
lt AS (SELECT page_id, string_agg(piece, '' ORDER BY i) AS text FROM tn
       WHERE NOT EXISTS (SELECT 1 FROM ge WHERE ge.page_id = tn.page_id AND ge.pre = tn.parent) AND NOT {tail}
       {"AND NOT after_comment" if comments else ""} GROUP BY 1)
SELECT page_id, n_elements, md5(coalesce(text, '')) AS digest FROM le LEFT JOIN lt USING (page_id)"""


def chrome() -> str:
    """nav, footer and header in turn, each undone when under 500 characters stay."""
    steps = [DOM + TEXT_NODES, "a0 AS (SELECT page_id, pre FROM el)", "t0 AS (SELECT * FROM tn)"]
    for k, tag in enumerate(("nav", "footer", "header"), 1):
        p = k - 1
        steps += [
            f"r{k} AS (SELECT page_id, pre, last FROM el SEMI JOIN a{p} USING (page_id, pre) WHERE tag = '{tag}')",
            f"g{k} AS (SELECT DISTINCT page_id, unnest(range(pre, last + 1)) AS pre FROM r{k})",
            f"tt{k} AS (SELECT * FROM t{p} x WHERE NOT EXISTS (SELECT 1 FROM g{k} g WHERE g.page_id = x.page_id AND g.pre = x.parent) "
            f"AND NOT EXISTS (SELECT 1 FROM r{k} r WHERE r.page_id = x.page_id AND r.pre = x.el AND NOT x.after_comment))",
            f"ok{k} AS (SELECT page_id FROM tt{k} GROUP BY 1 HAVING length(trim(string_agg(piece, '' ORDER BY i), ' \t\n\r')) >= 500)",
            f"a{k} AS (SELECT page_id, pre FROM a{p} x WHERE NOT (EXISTS (SELECT 1 FROM ok{k} o WHERE o.page_id = x.page_id) "
            f"AND EXISTS (SELECT 1 FROM g{k} g WHERE g.page_id = x.page_id AND g.pre = x.pre)))",
            f"t{k} AS (SELECT * FROM tt{k} UNION ALL SELECT * FROM t{p} x WHERE NOT EXISTS (SELECT 1 FROM ok{k} o WHERE o.page_id = x.page_id) "
            f"AND NOT EXISTS (SELECT 1 FROM tt{k} y WHERE y.page_id = x.page_id AND y.i = x.i))",
        ]
    return ", ".join(steps) + (
        " SELECT page_id, n_elements, md5(coalesce(text, '')) AS digest FROM (SELECT page_id, count(*) AS n_elements FROM a3 GROUP BY 1)"
        " LEFT JOIN (SELECT page_id, string_agg(piece, '' ORDER BY i) AS text FROM t3 GROUP BY 1) USING (page_id)"
    )


EMPTY = with_src(ORDER_PAGES_SQL) + TEXT_NODES + """,
why AS (
  SELECT page_id, list_append(anc, pre) AS path FROM el WHERE tag IN ('img', 'input', 'br', 'hr', 'meta', 'link', 'html', 'body', 'head')
  UNION ALL SELECT page_id, anc FROM tn WHERE el IS NULL AND NOT after_comment AND trim(piece, ' \t\n\r') <> ''
),
k AS (SELECT DISTINCT page_id, unnest(path) AS pre FROM why),
ge AS (SELECT page_id, pre FROM el ANTI JOIN k USING (page_id, pre)),
lt AS (SELECT page_id, string_agg(piece, '' ORDER BY i) AS text FROM tn
       WHERE NOT after_comment AND NOT EXISTS (SELECT 1 FROM ge WHERE ge.page_id = tn.page_id AND (ge.pre = tn.parent OR ge.pre = tn.el)) GROUP BY 1)
SELECT page_id, n_elements, md5(coalesce(text, '')) AS digest
FROM (SELECT page_id, count(*) AS n_elements FROM k SEMI JOIN el USING (page_id, pre) GROUP BY 1) LEFT JOIN lt USING (page_id)"""

NORM = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
SEGS = f"list_filter(string_split({part('url', 3)}, '/'), lambda s: s <> '')"

S: dict[str, str] = {}

S["read_pages"] = "SELECT page_id, url, length(html) AS chars FROM pages WHERE html <> ''"
S["sitemap_urls"] = f"""
SELECT page_id // 50 AS site, row_number() OVER (PARTITION BY page_id // 50 ORDER BY page_id) - 1 AS ord, {canon('url')} AS url
FROM pages WHERE (page_id // 50) % 4 <> 3"""
S["sitemap_scope"] = f"SELECT page_id, url FROM pages WHERE starts_with({part('url', 3)}, '/en')"
S["url_normalize"] = f"SELECT page_id, {canon('url')} AS full_url, {canon('url', False)} AS no_query FROM pages"
S["url_resolve"] = ANCHORS + f"""
SELECT page_id, ord, {rooted('url', 'href')} AS absolute,
  {part('url', 1)} || '://' || {part('url', 2)} || '/' || array_to_string(list_append(p[2:len(p) - 2], 'x'), '/') || '/' || substring(href, 2, 99) AS dotted
FROM a JOIN (SELECT page_id, url, string_split({part('url', 3)}, '/') AS p FROM pages) USING (page_id)"""
S["url_blocked"] = ANCHORS + " SELECT page_id, ord, ord % 3 <> 2 AS blocked FROM a"
S["url_domain"] = f"""
SELECT page_id, lower({part('url', 2)}) AS domain, lower({part('url', 2)}) = 'm.therou.example.com' AS same, true AS valid,
  CASE WHEN len(q) >= 2 THEN array_to_string(q[1:len(q) - 1], '/') END AS parent, {SEGS} AS segments
FROM (SELECT *, string_split(trim({part('url', 3)}, '/'), '/') AS q FROM pages)"""
S["url_increment"] = f"""
SELECT page_id, CASE WHEN regexp_matches({part('url', 4)}, '(^|&)page=[0-9]+') THEN
    regexp_replace(url, 'page=[0-9]+', 'page=' || (CAST(regexp_extract({part('url', 4)}, 'page=([0-9]+)', 1) AS BIGINT) + 1), 'g')
  ELSE url || CASE WHEN {part('url', 4)} <> '' THEN '&' ELSE '?' END || 'page=2' END AS next_url
FROM pages"""
S["url_valid_links"] = anchors_of(ORDER_PAGES_SQL) + " SELECT page_id, ord, NOT ends_with(href, '.pdf') AS valid FROM a"
S["token_counts"] = "WITH " + tokens() + " SELECT page_id, kind, tag, count(*) AS n, CAST(sum(length(t)) AS BIGINT) AS chars FROM tok GROUP BY ALL"
S["comments_dropped"] = "SELECT page_id, md5(regexp_replace(html, '(?s)<!--.*?-->', '', 'g')) AS digest FROM pages"
PAGE_TEXT = DOM + ", pt AS (SELECT page_id, string_agg(piece, '' ORDER BY i) AS text FROM tx GROUP BY 1)"
S["pages_needing_render"] = PAGE_TEXT + """
SELECT page_id, url, length(trim(text, ' \t\n\r')) AS text_chars FROM pt JOIN pages USING (page_id) WHERE text_chars < 500"""
S["page_fingerprints"] = PAGE_TEXT + """
SELECT page_id, url, md5(substring(text, 1, 4000)) AS fingerprint, n AS anchor_count
FROM pt JOIN pages USING (page_id) JOIN (SELECT page_id, count(*) FILTER (tag = 'a' AND t LIKE '%href=%') AS n FROM el GROUP BY 1) USING (page_id)"""
S["element_table"] = DOM + """
SELECT page_id, pre, last, parent, depth, sib_pos, tag_pos, tag_n, tag, cls, md5(text) AS text_digest, anc FROM el"""
S["element_table_shop"] = with_src(LIST_PAGES_SQL) + " SELECT page_id, pre, last, parent, tag, cls, text FROM el"
S["text_node_table"] = DOM + TEXT_NODES + """
SELECT tn.page_id, row_number() OVER (PARTITION BY tn.page_id ORDER BY tn.i) - 1 AS tord, tn.parent,
  coalesce(max(CASE WHEN e.parent = tn.parent AND e.i < tn.i THEN e.pre END), -1) AS after, md5(any_value(tn.piece)) AS digest
FROM tn JOIN (SELECT page_id, pre, i, parent FROM el) e ON e.page_id = tn.page_id GROUP BY tn.page_id, tn.i, tn.parent"""
S["subtrees_dropped"] = left_over(DOM, "tag IN ('ul', 'h1', 'div')")
S["subtrees_dropped_keep_tails"] = left_over(with_src(ORDER_PAGES_SQL), "tag IN ('b', 'span')", keep_tails=True)
S["noise_dropped"] = left_over(DOM, "tag IN ('script', 'style', 'noscript', 'svg', 'iframe')")
S["hidden_dropped"] = left_over(with_src(ORDER_PAGES_SQL), "t LIKE '%display:none%' OR t LIKE '% hidden>'")
S["chrome_dropped"] = chrome()
S["comment_nodes_dropped"] = left_over(DOM, "false", comments=True)
S["empty_dropped"] = EMPTY
S["attributes_sanitized"] = """
SELECT doc_id AS page_id, unnest([{'pre': 0, 'names': ['title'], 'title': CASE WHEN length(text) > 100 THEN substring(text, 1, 100) || '...' ELSE text END, 'src': NULL},
  {'pre': 1, 'names': ['src'], 'title': NULL, 'src': ''}], recursive := true) FROM documents"""
S["repeating_groups"] = DOM + """
SELECT page_id, parent, tag, coalesce(cls, '') AS cls, count(*) AS n FROM el WHERE parent >= 0 GROUP BY ALL HAVING count(*) >= 3"""
S["html_rendered"] = f"WITH src AS ({LIST_PAGES_SQL}) SELECT page_id, html FROM src"
S["html_annotated"] = with_src(ORDER_PAGES_SQL) + " SELECT page_id, count(*) AS n, max(CASE WHEN tag = 'h1' THEN 'e' || pre END) AS h1_aid FROM el GROUP BY 1"
S["pages_cleaned"] = """
SELECT o_orderkey AS page_id, concat('<html><head><title>Order ', o_orderkey, '</title></head><body><div class="main" id="main"><h1 data-testid="order-title">Order ', o_orderkey,
  '</h1><span class="price">$ ', CAST(floor(o_totalprice) AS BIGINT), '</span><div class="body"><p>Placed by ', o_custkey,
  '</p><p>Copyright</p><p>Copyright</p></div><a class="prev" href="/order/', o_orderkey - 1, '">previous</a><a href="/files/', o_orderkey, '.pdf">invoice</a></div></body></html>') AS html
FROM orders"""
S["repeats_truncated"] = f"""
WITH src AS ({LIST_PAGES_SQL}),
cards AS (
  SELECT page_id, html, unnest(c) AS card, generate_subscripts(c, 1) AS k
  FROM (SELECT *, regexp_extract_all(html, '<li class.*?</li>') AS c FROM src)
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY page_id, regexp_extract(card, 'class="([^"]*)"', 1) ORDER BY k) AS rn,
    min(k) OVER (PARTITION BY page_id, regexp_extract(card, 'class="([^"]*)"', 1)) AS first
  FROM cards
),
kept AS (SELECT page_id, string_agg(card, '' ORDER BY k) AS body FROM ranked WHERE rn <= 3 GROUP BY 1),
notes AS (
  SELECT page_id, string_agg('<!-- truncated ' || n || ' items -->', '' ORDER BY first) AS note
  FROM (SELECT page_id, first, count(*) AS n FROM ranked WHERE rn > 3 GROUP BY ALL) GROUP BY 1
),
cut AS (
  SELECT page_id, CASE WHEN length(html) <= 2500 THEN html ELSE substring(regexp_extract(html, '^(.*<ul class="cards">)', 1)
    || body || coalesce(note, '') || regexp_extract(html, '(</ul>.*)$', 1), 1, 2500) END AS html
  FROM src LEFT JOIN kept USING (page_id) LEFT JOIN notes USING (page_id)
)
SELECT page_id, length(html) AS chars, md5(html) AS digest FROM cut"""
S["aid_resolved"] = DOM + " SELECT page_id, 'e' || pre AS aid, tag, pre FROM el WHERE pre % 2 = 0"
S["element_texts"] = DOM + r"""
SELECT page_id, pre, CASE WHEN length(x) > 100 THEN substring(x, 1, 100) || '...' ELSE x END AS sample, substring(x, 1, 100) AS plain
FROM (SELECT page_id, pre, trim(text, ' \t\n\r') AS x FROM el)""".replace(r"\t\n\r", "\t\n\r")
S["text_contents"] = DOM + f" SELECT page_id, pre, md5({NORM.format('text')}) AS digest FROM el"
DIGITS, DATE = "regexp_full_match({0}, '[0-9]+')", "regexp_full_match({0}, '[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}|[0-9]{{8}}|[0-9]{{4}}')"
TOKEN = "(regexp_full_match(lower({0}), '[0-9a-f]{{8,}}|[0-9a-f-]{{18,}}') OR regexp_full_match({0}, '[a-zA-Z0-9_-]{{20,}}'))"
NORMSEG = ("CASE WHEN " + DIGITS + " THEN '{{id}}' WHEN " + DATE + " THEN '{{date}}' WHEN " + TOKEN
           + " THEN '{{token}}' WHEN length({0}) > 30 THEN '{{var}}' ELSE lower({0}) END")


def schema_sql(urls: str = "urls", grp: str = "host") -> str:
    """CTEs seg and slots from ``urls(grp, ord, url)``."""
    s = "seg"
    return f"""
segs AS (SELECT {grp}, ord, unnest(x) AS seg, generate_subscripts(x, 1) - 1 AS pos FROM (SELECT {grp}, ord, {SEGS} AS x FROM {urls})),
segn AS (SELECT {grp}, pos, seg, count(*) AS n, min(ord) AS first FROM segs GROUP BY ALL),
schema AS (
  SELECT {grp}, pos, CAST(sum(n) AS BIGINT) AS total, count(*) AS n_distinct,
    -sum((n / t) * log2(n / t)) AS entropy,
    CASE WHEN sum(CASE WHEN {DIGITS.format(s)} THEN n ELSE 0 END) / sum(n) >= 0.6 THEN '{{id}}'
         WHEN sum(CASE WHEN {DATE.format(s)} THEN n ELSE 0 END) / sum(n) >= 0.5 THEN '{{date}}'
         WHEN sum(CASE WHEN {TOKEN.format(s)} THEN n ELSE 0 END) / sum(n) >= 0.5 THEN '{{token}}'
         WHEN count(*) / sum(n) > 0.6 OR -sum((n / t) * log2(n / t)) > 1.2 THEN '{{var}}'
         ELSE lower((list(seg ORDER BY n DESC, first))[1]) END AS slot
  FROM (SELECT *, sum(n) OVER (PARTITION BY {grp}, pos) AS t FROM segn) GROUP BY {grp}, pos
),
slots AS (SELECT {grp}, list(slot ORDER BY pos) AS sl FROM schema GROUP BY 1),
pats AS (
  SELECT {grp}, pattern, count(*) AS n FROM (
    SELECT u.{grp}, lower({part('url', 2)}) || '/' || array_to_string(list_transform({SEGS}, lambda x, i:
      CASE WHEN coalesce(sl[i], '{{var}}') LIKE '{{%' THEN {NORMSEG.format('x')} ELSE lower(x) END), '/') AS pattern
    FROM {urls} u LEFT JOIN slots USING ({grp})) GROUP BY ALL
)"""


HOST_URLS = f"urls AS (SELECT lower({part('url', 2)}) AS host, page_id AS ord, {canon('url')} AS url FROM pages)"
S["host_link_profile"] = ANCHORS + ", " + HOST_URLS + ", " + schema_sql() + f""",
e AS (SELECT lower({part('url', 2)}) AS host, {canon(rooted('url', 'href'))} AS dst FROM a JOIN pages USING (page_id)),
l AS (SELECT host, count(*) AS n_links, count(DISTINCT dst) AS n_targets FROM e GROUP BY 1),
t AS (SELECT host, CAST(sum(n) AS BIGINT) AS n_pages, (list(pattern ORDER BY n DESC, pattern))[1] AS top_pattern, max(n) AS top_n FROM pats GROUP BY 1)
SELECT host, n_pages, coalesce(n_links, 0) AS n_links, coalesce(n_targets, 0) AS n_targets, top_pattern, top_n FROM t LEFT JOIN l USING (host)"""


# ---- stability -----------------------------------------------------------

LISTS = with_src(LIST_PAGES_SQL)
ORDERS = with_src(ORDER_PAGES_SQL)
SHOP_PAGES = f"{ORDER_PAGES_SQL} UNION ALL {LIST_PAGES_SQL}"
RANDOM = "'^[a-z]{2,4}-[a-zA-Z0-9]{4,}$|^[a-f0-9]{8,}$|^_?[a-zA-Z]+_[a-zA-Z0-9]{4,}$|^__\\w+-\\w+$|^[a-zA-Z0-9]{20,}$|^[0-9a-f]{8}-[0-9a-f]{4}-|^[0-9]+$'"
S["random_tokens"] = f"""
SELECT lang, regexp_matches(w, {RANDOM}) AS is_random, count(*) AS n, count(DISTINCT w) AS n_words
FROM (SELECT lang, unnest(string_split(regexp_replace(text, '[^A-Za-z0-9_\\-]+', ' ', 'g'), ' ')) AS w FROM documents) WHERE w <> '' GROUP BY ALL"""
ATTRS = ("class", "id", "data-sku", "data-kind", "data-unit", "data-url", "data-testid", "href", "style", "hidden")


def attr_rows(el: str = "el") -> str:
    """CTE att(page_id, pre, attr, value)."""
    values = ", ".join(
        "CASE WHEN t LIKE '% hidden>' THEN '' END" if a == "hidden" else attr("t", a) for a in ATTRS
    )
    names = ", ".join(f"'{a}'" for a in ATTRS)
    return (f"att AS (SELECT page_id, pre, attr, value FROM (SELECT page_id, pre, unnest([{names}]) AS attr, "
            f"unnest([{values}]) AS value FROM {el}) WHERE value IS NOT NULL)")


SINGLE = f"""CASE WHEN attr IN ('data-testid', 'data-test', 'data-cy', 'role', 'aria-label', 'aria-labelledby', 'itemprop', 'itemtype', 'name') THEN 'stable'
  WHEN regexp_matches(attr, '^(data-reactid|data-react-checksum|data-v-|_ngcontent-|data-styled-|jsname|jsaction|jscontroller)') THEN 'random'
  WHEN regexp_matches(value, {RANDOM}) THEN 'random' ELSE 'unknown' END"""
S["single_attributes"] = with_src(SHOP_PAGES, texts=False) + ", " + attr_rows() + f" SELECT attr, {SINGLE} AS label, count(*) AS n FROM att GROUP BY ALL"
SIBLINGS = f"""c AS (SELECT page_id, parent, tag, pre, cls, {cls_tokens('cls')} AS toks FROM el WHERE parent >= 0),
sib AS (SELECT a.page_id, a.pre, b.pre AS other, b.toks AS otoks FROM c a JOIN c b ON a.page_id = b.page_id AND a.parent = b.parent AND a.tag = b.tag
  AND (list_has_any(a.toks, b.toks) OR (coalesce(a.cls, '') = '' AND coalesce(b.cls, '') = '')))"""
LISTS_BARE = with_src(LIST_PAGES_SQL, texts=False)
S["attribute_stability"] = LISTS_BARE + ", " + attr_rows() + ", " + SIBLINGS + f""",
st AS (
  SELECT x.page_id, x.pre, x.attr, any_value(x.value) AS value, count(s.other) AS total, count(DISTINCT CASE WHEN s.other IS NOT NULL THEN coalesce(y.value, '') END) AS n
  FROM att x LEFT JOIN sib s ON s.page_id = x.page_id AND s.pre = x.pre
  LEFT JOIN att y ON y.page_id = s.page_id AND y.pre = s.other AND y.attr = x.attr GROUP BY x.page_id, x.pre, x.attr
)
SELECT page_id, pre, attr, value, CASE WHEN {SINGLE} <> 'unknown' THEN {SINGLE} WHEN total < 2 THEN 'unknown' WHEN n = 1 THEN 'stable'
  WHEN n = total THEN 'business' WHEN n / total < 0.3 THEN 'business_category' ELSE 'random' END AS classification FROM st"""
S["class_token_stability"] = LISTS_BARE + ", " + SIBLINGS + f""",
ct AS (SELECT page_id, pre, unnest(x) AS token, generate_subscripts(x, 1) - 1 AS pos FROM (SELECT page_id, pre, {cls_tokens('cls')} AS x FROM el)),
st AS (
  SELECT ct.page_id, ct.pre, pos, token, count(other) AS total, count(*) FILTER (list_contains(otoks, token)) AS freq
  FROM ct LEFT JOIN sib USING (page_id, pre) GROUP BY ALL
)
SELECT page_id, pre, pos, token, CASE WHEN regexp_matches(token, {RANDOM}) THEN 'random' WHEN total < 2 THEN 'unknown' WHEN freq = total THEN 'stable'
  WHEN freq > 0 AND freq < total * 0.3 THEN 'conditional' WHEN freq <= 1 AND regexp_matches(token, '[0-9]|^[a-z]+-[a-z]+-') THEN 'business'
  WHEN freq <= 1 THEN 'random' ELSE 'stable' END AS classification FROM st"""
S["similar_siblings"] = LISTS_BARE + ", " + SIBLINGS + " SELECT page_id, pre, other AS sib_pre FROM sib"
S["sibling_attribute_values"] = """SELECT o_orderkey // 20 + 10000000000 AS page_id, o_orderpriority AS value, count(*) * any_value(cards) AS n
FROM orders JOIN (SELECT o_orderkey // 20 AS k, count(*) AS cards FROM orders GROUP BY 1) ON k = o_orderkey // 20 GROUP BY 1, 2"""
S["ancestor_chains"] = DOM + """
SELECT e.page_id, e.pre, coalesce(list(a.tag ORDER BY a.depth DESC) FILTER (a.tag IS NOT NULL), [])[1:10] AS tags
FROM el e LEFT JOIN el a ON a.page_id = e.page_id AND list_contains(e.anc, a.pre) GROUP BY ALL"""
S["neighbour_siblings"] = ORDERS + TEXT_NODES + """,
m AS (SELECT ev.page_id, ev.parent, ev.i, el.pre, el.tag, el.cls, trim(el.text, ' \t\n\r') AS text FROM ev LEFT JOIN el ON el.page_id = ev.page_id AND el.pre = ev.el),
w AS (SELECT *, lag(tag) OVER x AS prev_tag, lag(text) OVER x AS pt, lead(tag) OVER x AS next_tag, lead(cls) OVER x AS nc FROM m
  WINDOW x AS (PARTITION BY page_id, parent ORDER BY i))
SELECT page_id, pre, CASE WHEN parent >= 0 THEN prev_tag END AS prev_tag, CASE WHEN prev_tag IS NOT NULL AND parent >= 0 THEN substring(pt, 1, 50) END AS prev_text,
  CASE WHEN parent >= 0 THEN next_tag END AS next_tag, CASE WHEN next_tag IS NOT NULL AND parent >= 0 THEN coalesce(nc, '') END AS next_class FROM w WHERE pre IS NOT NULL"""
# ---- selectors -----------------------------------------------------------

S["selectors_parsed"] = ANCHORS + " SELECT page_id, ord, 4 AS n_steps, ord + 1 AS pos, '@href' AS suffix, false AS failed FROM a"
UP = "JOIN el p ON p.page_id = e.page_id AND p.pre = e.parent"
S["selector_matches"] = DOM + f"""
SELECT e.page_id, '//nav//a/@href' AS xpath, e.pre, e.tag, {attr('e.t', 'href')} AS value FROM el e WHERE e.tag = 'a'
  AND EXISTS (SELECT 1 FROM el n WHERE n.page_id = e.page_id AND n.tag = 'nav' AND list_contains(e.anc, n.pre))
UNION ALL SELECT e.page_id, '//ul/li[2]/a', e.pre, e.tag, e.text FROM el e {UP} JOIN el g ON g.page_id = p.page_id AND g.pre = p.parent
  WHERE e.tag = 'a' AND p.tag = 'li' AND p.tag_pos = 2 AND g.tag = 'ul'
UNION ALL SELECT e.page_id, './/article/h1', e.pre, e.tag, e.text FROM el e {UP} WHERE e.tag = 'h1' AND p.tag = 'article'
UNION ALL SELECT e.page_id, '/html/body/footer', e.pre, e.tag, e.text FROM el e {UP} JOIN el g ON g.page_id = p.page_id AND g.pre = p.parent
  WHERE e.tag = 'footer' AND p.tag = 'body' AND g.tag = 'html' AND g.parent = -1
UNION ALL SELECT page_id, '//div[@class=''ad'' or @id=''x'']', pre, tag, text FROM el WHERE tag = 'div' AND (cls = 'ad' OR id_attr = 'x')
UNION ALL SELECT e.page_id, '//nav/ul/*[3]', e.pre, e.tag, e.text FROM el e {UP} JOIN el g ON g.page_id = p.page_id AND g.pre = p.parent
  WHERE e.sib_pos = 3 AND p.tag = 'ul' AND g.tag = 'nav'"""
S["selector_matches_without_root"] = DOM + f"""
SELECT page_id, x AS xpath, tag, text AS value FROM el, (VALUES ('//h1'), ('.//h1')) v(x) WHERE tag = 'h1'
UNION ALL SELECT e.page_id, './/nav//a/@href', e.tag, {attr('e.t', 'href')} FROM el e WHERE e.tag = 'a'
  AND EXISTS (SELECT 1 FROM el n WHERE n.page_id = e.page_id AND n.tag = 'nav' AND list_contains(e.anc, n.pre))"""
S["selector_unique"] = DOM + """,
x AS (SELECT page_id, '//h1' AS xpath, count(*) FILTER (tag = 'h1') AS n FROM el GROUP BY 1
  UNION ALL SELECT page_id, '//li', count(*) FILTER (tag = 'li') FROM el GROUP BY 1
  UNION ALL SELECT page_id, '//footer', count(*) FILTER (tag = 'footer') FROM el GROUP BY 1
  UNION ALL SELECT page_id, '//div[@class=''ad'']', count(*) FILTER (tag = 'div' AND cls = 'ad') FROM el GROUP BY 1
  UNION ALL SELECT page_id, '//h6', count(*) FILTER (tag = 'h6') FROM el GROUP BY 1)
SELECT page_id, xpath, n, n = 1 AS is_unique FROM x"""
S["selectors_generated"] = """
SELECT o_orderkey AS page_id, field, xpath, confidence FROM orders, (VALUES ('h1', './/h1[@data-testid=''order-title'']', 0.98), ('i', './/i', 0.7),
  ('footer', './/footer', 0.7), ('span', NULL, NULL)) v(field, xpath, confidence)
UNION ALL SELECT o_orderkey, 'b', './/b', 0.7 FROM orders WHERE o_orderpriority = '1-URGENT'"""
S["selectors_by_ancestor"] = ORDERS + """
SELECT page_id, pre, CASE WHEN tag <> 'p' THEN './/*[contains(@class, ''main'')]//' || tag END AS xpath, CASE WHEN tag <> 'p' THEN 0.7 END AS confidence
FROM el WHERE tag IN ('h1', 'i', 'p')"""
S["selectors_by_position"] = DOM + """,
lv AS (SELECT page_id, pre, depth, parent, CASE WHEN tag_n > 1 AND parent >= 0 THEN tag || '[' || tag_pos || ']' ELSE tag END AS x FROM el)
SELECT a.page_id, a.pre, '//' || coalesce(c.x || '/', '') || coalesce(b.x || '/', '') || a.x AS xpath
FROM lv a LEFT JOIN lv b ON b.page_id = a.page_id AND b.pre = a.parent LEFT JOIN lv c ON c.page_id = b.page_id AND c.pre = b.parent"""
S["selectors_of_containers"] = """WITH c AS (SELECT o_orderkey // 20 AS list, count(*) AS k FROM orders GROUP BY 1)
SELECT list + 10000000000 AS page_id, 'ul' AS field, '//ul/li' AS xpath, k AS n FROM c
UNION ALL SELECT list + 10000000000, 'li', '//li[contains(@class, ''card'')]', k FROM c JOIN orders ON o_orderkey // 20 = list"""
S["selector_strings"] = ANCHORS + """,
s AS (SELECT page_id, ord, ord % 4 AS k, CASE ord % 4 WHEN 0 THEN '//a/text()' WHEN 1 THEN '//a[@href]/@title' WHEN 2 THEN '//a[@href]'
  ELSE '//a[@href=''' || href || ''']' END AS s FROM a)
SELECT page_id, ord, s AS stripped, CASE k WHEN 0 THEN '//a' WHEN 1 THEN '//a[@href]' ELSE s END AS bare,
  CASE k WHEN 0 THEN '//a' WHEN 1 THEN '//a[@href]' ELSE s END || '/@href' AS as_href, s AS as_text FROM s"""
S["selectors_validated"] = """
SELECT o_orderkey AS page_id, CASE o_orderkey % 3 WHEN 0 THEN '//h1/text()' WHEN 1 THEN '//div' ELSE '//h2' END AS xpath, o_orderkey % 3 = 0 AS valid FROM orders"""
S["selectors_chosen"] = """
SELECT o_orderkey AS page_id, CASE WHEN o_orderkey % 3 < 2 THEN '//h1' END AS xpath, NULL::VARCHAR AS fallback_xpath,
  CASE o_orderkey % 3 WHEN 0 THEN 0.9 WHEN 1 THEN 0.75 END AS confidence FROM orders"""
S["selectors_best"] = """
SELECT o_orderkey AS page_id, 'h1' AS field, CASE WHEN o_orderkey % 3 < 2 THEN '//h1' ELSE './/h1[@data-testid=''order-title'']' END AS xpath,
  CASE o_orderkey % 3 WHEN 0 THEN 0.9 WHEN 1 THEN 0.75 ELSE 0.98 END AS confidence FROM orders
UNION ALL SELECT o_orderkey, 'span', '//body/div/span[1]', 0.3 FROM orders"""

# ---- extraction: the tables the pages were made of -----------------------

PRICE_TEXT = "'$ ' || CAST(floor(o_totalprice) AS BIGINT)"
S["detail_records"] = f"""
SELECT o_orderkey AS page_id, url, 'Order ' || o_orderkey AS title, {PRICE_TEXT} AS price, 'Placed by ' || o_custkey || chr(10) || 'Copyright' AS body,
  '/order/' || (o_orderkey - 1) AS prev, CASE WHEN o_orderpriority = '1-URGENT' THEN 'urgent' END AS flag, 'Placed by ' || o_custkey || 'CopyrightCopyright' AS content
FROM orders JOIN (SELECT page_id, url FROM ({ORDER_PAGES_SQL})) p ON p.page_id = o_orderkey"""
S["list_records"] = f"""
SELECT n + {LIST_BASE} AS page_id, url, item, 'Order ' || o_orderkey AS name, '/order/' || o_orderkey AS link, {PRICE_TEXT} AS cost, 'About' AS menu
FROM (SELECT *, o_orderkey // 20 AS n, row_number() OVER (PARTITION BY o_orderkey // 20 ORDER BY o_orderkey) - 1 AS item FROM orders)
JOIN (SELECT page_id, url FROM ({LIST_PAGES_SQL})) p ON p.page_id = n + {LIST_BASE}"""
S["batch_records"] = """
SELECT 'order' AS template_id, count(*) AS n_records, count(*) AS n_pages FROM orders
UNION ALL SELECT 'list', count(*), count(DISTINCT o_orderkey // 20) FROM orders"""
S["record_fill"] = "SELECT o_orderkey AS page_id, CASE WHEN o_orderpriority = '1-URGENT' THEN 6 ELSE 5 END AS filled, 6 AS fields FROM orders"
S["paragraph_text"] = DOM + f""",
p AS (SELECT e.page_id, e.pre, {NORM.format('e.text')} AS v FROM el e WHERE e.tag = 'p'
  AND EXISTS (SELECT 1 FROM el a WHERE a.page_id = e.page_id AND a.tag = 'article' AND list_contains(e.anc, a.pre))),
q AS (SELECT page_id, pre, v, lag(v) OVER (PARTITION BY page_id ORDER BY pre) AS before FROM p WHERE v <> '')
SELECT page_id, md5(string_agg(v, chr(10) ORDER BY pre) FILTER (before IS DISTINCT FROM v)) AS digest
FROM pages LEFT JOIN q USING (page_id) GROUP BY 1"""
S["low_quality_documents"] = """
SELECT doc_id, trim(text) = '' OR regexp_matches(lower(text), 'copyright|all rights reserved|未经许可|请勿转载|版权所有') AS low FROM documents"""
S["export_heads"] = """
SELECT 'order' AS template_id, 'https://shop.example.com/' AS source_url, 'detail' AS page_type, count(*) AS total_records, 6 AS n_fields FROM orders
UNION ALL SELECT 'list', 'https://shop.example.com/', 'list', count(*), 4 FROM orders"""
S["export_documents"] = f"""
WITH cards AS (SELECT o_orderkey, n, page_id, url, row_number() OVER (PARTITION BY n ORDER BY o_orderkey) - 1 AS item
  FROM (SELECT *, o_orderkey // 20 AS n FROM orders) JOIN (SELECT page_id, url FROM ({LIST_PAGES_SQL})) p ON p.page_id = n + {LIST_BASE})
SELECT CAST(page_id AS VARCHAR) AS template_id, 1 AS section, page_id, CAST(item AS INTEGER) AS item,
  concat(CASE WHEN item > 0 THEN ',' END, '{{"url":"', url, '","data":{{"name":"Order ', o_orderkey, '","link":"/order/', o_orderkey, '"}}}}') AS text FROM cards
UNION ALL SELECT CAST(page_id AS VARCHAR), 2, NULL, NULL, ']}}' FROM cards WHERE item = 0
UNION ALL SELECT CAST(page_id AS VARCHAR), 0, NULL, NULL, concat('{{"source_url":"https://shop.example.com/","page_type":"list","total_records":', count(*),
  ',"fields_definition":[{{"name":"name","xpath":".//a","description":"","extract":"text","confidence":0.9}},{{"name":"link","xpath":"a/@href","description":"","extract":"attribute","confidence":0.8}}],"pages":[')
FROM cards GROUP BY page_id"""

# ---- links and patterns --------------------------------------------------

SHOP = "'https://shop' || ((page_id - 10000000000) // 10 % 7) || '.example.com'"
S["links_by_selector"] = LISTS_BARE + f"""
SELECT page_id, x AS xpath, pre, {SHOP} || h AS target FROM (
  SELECT page_id, '//ul//a/@href' AS x, pre, {attr('t', 'href')} AS h FROM el WHERE tag = 'a' AND cls = 'lnk'
  UNION ALL SELECT page_id, '//div[contains(@class,''menu'')]/a', pre, {attr('t', 'href')} FROM el WHERE tag = 'a' AND cls IS NULL
  UNION ALL SELECT page_id, '//button/@data-url', pre, {attr('t', 'data-url')} FROM el WHERE tag = 'button')"""
S["page_links_with_base"] = ANCHORS + f" SELECT page_id, ord, {canon(rooted('url', "('/deep/dir' || href)"))} AS target FROM a JOIN pages USING (page_id)"
S["page_link_edges"] = ANCHORS + f" SELECT page_id, url AS src, ord, {canon(rooted('url', 'href'))} AS dst FROM a JOIN pages USING (page_id)"
PATTERNS = "WITH " + HOST_URLS + ", " + schema_sql()
S["url_schema"] = PATTERNS + " SELECT host, pos, total, n_distinct, round(entropy, 6) + 0.0 AS entropy, slot FROM schema"
S["url_pattern_counts"] = PATTERNS + " SELECT host, pattern, n FROM pats"
S["segment_kinds"] = f"""
WITH s AS (SELECT unnest(string_split_regex(text, '\\s+')) AS s FROM documents UNION ALL SELECT unnest({SEGS}) FROM pages)
SELECT CASE WHEN k LIKE '{{%' THEN k ELSE 'literal' END AS kind, {DATE.format('s')} AS dated, {TOKEN.format('s')} AS tokenish, count(*) AS n
FROM (SELECT s, {NORMSEG.format('s')} AS k FROM s WHERE s <> '') GROUP BY ALL"""
EFFECTIVE = ("(NOT regexp_matches(pattern, 'about|contact|privacy|terms|category|tag|help|login|signup') AND "
             "(n >= 3 OR (n >= 2 AND regexp_matches(pattern, 'article|detail|post|/p/|\\{id\\}'))))")
S["pattern_effects"] = PATTERNS + f" SELECT host, pattern, {EFFECTIVE} AS effective FROM pats"
SUPPORT = f"SELECT GRP, sum(CASE WHEN {EFFECTIVE} THEN n ELSE 0 END) / sum(n) AS coverage, max(n) / sum(n) AS top FROM pats GROUP BY 1"
S["pattern_supports"] = PATTERNS + ", s AS (" + SUPPORT.replace("GRP", "host") + ") SELECT host, round(coverage, 6) AS coverage, round(top, 6) AS top FROM s"
SCORES = LISTS_BARE + f""",
al AS (
  SELECT (page_id - {LIST_BASE}) // 10 AS chain, cand, page_id, pre,
    CASE WHEN h LIKE '?%' THEN {SHOP} || '/archive/' || ((page_id - {LIST_BASE}) // 10) || h ELSE {SHOP} || h END AS target
  FROM (SELECT page_id, pre, cls, {attr('t', 'href')} AS h FROM el WHERE tag = 'a') x, (VALUES (0), (1), (2)) v(cand)
  WHERE cand = 0 OR (cand = 1 AND cls = 'lnk') OR (cand = 2 AND cls IS NULL)
),
dd AS (SELECT chain || '|' || cand AS grp, chain, cand, target AS url, count(*) AS copies, min(page_id * 1000 + pre) AS ord FROM al GROUP BY ALL),
urls AS (SELECT grp, ord, url FROM dd), """ + schema_sql(grp="grp") + ", sup AS (" + SUPPORT.replace("GRP", "grp") + """),
tot AS (SELECT grp, chain, cand, count(*) AS n_urls, sum(copies) AS matches FROM dd GROUP BY ALL),
sc AS (SELECT *, n_urls / matches AS valid_ratio, 0.3 * n_urls / matches + 0.4 * coverage + 0.15 * top + 0.15 * least(1.0, n_urls / 50) AS score FROM tot JOIN sup USING (grp))"""
S["link_scores"] = SCORES + " SELECT chain, cand, n_urls, round(valid_ratio, 6) AS valid_ratio, round(coverage, 6) AS coverage, round(top, 6) AS top, round(score, 6) AS score FROM sc"
S["links_selected"] = SCORES + """,
pl AS (SELECT chain, cand, score, row_number() OVER (PARTITION BY chain ORDER BY round(score, 9) DESC, cand) AS place, max(score) OVER (PARTITION BY chain) AS best FROM sc),
ch AS (SELECT dd.chain, url, min([place, ord]) AS o FROM dd JOIN pl USING (chain, cand) WHERE place = 1 OR (place = 2 AND best - score <= 0.1 + 1e-9) GROUP BY ALL)
SELECT chain, row_number() OVER (PARTITION BY chain ORDER BY o) AS rank, url FROM ch QUALIFY rank <= 50"""
S["links_deduped"] = ANCHORS + f" SELECT {canon(rooted('url', 'href'))} AS url, min(page_id * 1000 + ord) AS ord FROM a JOIN pages USING (page_id) GROUP BY 1"
S["domain_buckets"] = f"WITH {HOST_URLS} SELECT host, count(*) AS n, min(ord) AS bucket_ord, arg_min(url, ord) AS template_url FROM urls GROUP BY 1"
S["neighbour_pages"] = f"""
SELECT page_id, 1 AS rank, regexp_extract(url, '^(.*/)[^/]*$', 1) || (page_id - 1) AS url FROM ({ORDER_PAGES_SQL})"""
FIRSTSEG = f"CASE WHEN trim({part('url', 3)}, '/') <> '' THEN string_split(trim({part('url', 3)}, '/'), '/')[1] END"
PATHPAT = f"""WITH {HOST_URLS},
f AS (SELECT host, {FIRSTSEG} AS seg, count(*) AS n, min(ord) AS first FROM urls GROUP BY ALL),
t AS (SELECT host, CAST(sum(n) AS BIGINT) AS total, (list(seg ORDER BY n DESC, first) FILTER (seg IS NOT NULL))[1] AS seg, max(n) FILTER (seg IS NOT NULL) AS n FROM f GROUP BY 1),
p AS (SELECT host, total, CASE WHEN total >= 3 AND n >= total * 0.3 THEN '/' || seg || '/*' END AS pattern FROM t)"""
S["path_patterns"] = PATHPAT + " SELECT host, total, pattern FROM p"
S["urls_under_pattern"] = PATHPAT + f""",
m AS (SELECT host, ord, url, coalesce(starts_with({part('url', 3)}, pattern[1:len(pattern) - 1]) OR {part('url', 3)} = pattern[1:len(pattern) - 2], true) AS under FROM urls JOIN p USING (host))
SELECT host, ord, url FROM (SELECT *, avg(CAST(under AS INT)) OVER (PARTITION BY host) AS share FROM m) WHERE under OR share < 0.3"""
SHOP_EDGES = with_src(SHOP_PAGES, texts=False) + f""",
eg0 AS (SELECT e.page_id, url AS src, e.pre, {attr('e.t', 'href')} AS h FROM el e JOIN src USING (page_id) WHERE e.tag = 'a'),
eg AS (SELECT page_id, src, row_number() OVER (PARTITION BY page_id ORDER BY pre) - 1 AS ord,
  {part('src', 1)} || '://' || {part('src', 2)} || CASE WHEN h LIKE '?%' THEN {part('src', 3)} || h ELSE h END AS dst FROM eg0),
seeds AS (SELECT page_id, url FROM src WHERE page_id >= {LIST_BASE} AND (page_id - {LIST_BASE}) % 10 = 0)"""
S["crawl_depths"] = SHOP_EDGES + """,
r1 AS (SELECT DISTINCT s.url AS seed, dst AS url FROM seeds s JOIN eg ON src = s.url),
r2 AS (SELECT DISTINCT seed, dst AS url FROM r1 JOIN eg ON src = r1.url),
al AS (SELECT url AS seed, url, 0 AS depth FROM seeds UNION ALL SELECT *, 1 FROM r1 UNION ALL SELECT *, 2 FROM r2)
SELECT seed, url, min(depth) AS depth FROM al GROUP BY ALL"""
S["crawl_budget"] = SHOP_EDGES + """,
l1 AS (SELECT s.url AS seed, dst AS url, min(ord) AS o FROM seeds s JOIN eg ON src = s.url WHERE dst <> s.url GROUP BY ALL)
SELECT url AS seed, url, 0 AS depth, 1 AS rank FROM seeds
UNION ALL SELECT * FROM (SELECT seed, url, 1 AS depth, row_number() OVER (PARTITION BY seed ORDER BY o) + 1 AS rank FROM l1) WHERE rank <= 15"""
S["discovered_pages"] = SHOP_EDGES + f""",
maps AS (SELECT s.url AS seed, p.page_id AS ord, p.url FROM ({ORDER_PAGES_SQL}) p JOIN seeds s ON s.page_id = {LIST_BASE} + p.page_id // 200 * 10)
SELECT seed, rank + 1 AS rank, url FROM (SELECT seed, url, row_number() OVER (PARTITION BY seed ORDER BY ord) AS rank FROM maps) WHERE rank < 100
UNION ALL SELECT url, 1, url FROM seeds"""

# ---- pagination ----------------------------------------------------------

LIST_N = f"n AS (SELECT page_id - {LIST_BASE} AS n, page_id, url FROM ({LIST_PAGES_SQL}))"
NEXT_URL = "regexp_extract(url, '^([^?]*)', 1) || '?page=' || (n % 10 + 2)"
S["next_links"] = f"WITH {LIST_N} SELECT page_id, 0 AS ord, {NEXT_URL} AS target FROM n WHERE n % 10 < 9"
S["next_clicks"] = f"WITH {LIST_N} SELECT page_id, k AS ord, {NEXT_URL} AS target FROM n, (VALUES (0), (1)) v(k) WHERE n % 10 < 9"
S["next_load_more"] = f"WITH {LIST_N} SELECT page_id, k AS ord, regexp_extract(url, '^(https://[^/]*)', 1) || '/more/' || n AS target FROM n, (VALUES (0), (1)) v(k)"
S["next_params"] = "SELECT page_id, 0 AS ord, " + canon("next_url") + " AS target FROM (" + S["url_increment"] + ")"
S["next_pages"] = f"WITH {LIST_N} SELECT a.page_id, 'link' AS strategy, b.url AS target FROM n a JOIN n b ON b.n = a.n + 1 AND a.n // 10 = b.n // 10"
CHAIN = f"WITH {LIST_N}, last AS (SELECT n // 10 AS c, least(count(*), 5) AS len FROM n GROUP BY 1)"
S["pagination_chains"] = CHAIN + f" SELECT {LIST_BASE} + c * 10 AS seed, n.n % 10 + 1 AS n, page_id, url FROM n JOIN last ON c = n.n // 10 WHERE n.n % 10 < len"
S["pagination_stops"] = f"""WITH {LIST_N}, t AS (SELECT n // 10 AS c, count(*) AS k FROM n GROUP BY 1)
SELECT {LIST_BASE} + c * 10 AS seed, least(k, 5) AS pages, CASE WHEN k >= 5 THEN 'TARGET_REACHED' WHEN k = 1 THEN 'NO_STRATEGY_ADVANCED' ELSE 'NO_PROGRESS_LIMIT' END AS stop_reason FROM t"""
S["first_new_candidate"] = ANCHORS + f""",
l AS (SELECT page_id, ord, {canon(rooted('url', 'href'))} AS target FROM a JOIN pages USING (page_id))
SELECT page_id, count(*) AS n_candidates, arg_min(target, ord) FILTER (NOT EXISTS (SELECT 1 FROM l o WHERE o.page_id = l.page_id AND o.ord < 2 AND o.target = l.target)) AS target
FROM l GROUP BY page_id""".replace("arg_min(target, ord) FILTER (NOT EXISTS (SELECT 1 FROM l o WHERE o.page_id = l.page_id AND o.ord < 2 AND o.target = l.target))", "arg_min(target, ord) FILTER (f >= 2)").replace("FROM l GROUP BY page_id", "FROM (SELECT *, min(ord) OVER (PARTITION BY page_id, target) AS f FROM l) GROUP BY page_id")
S["progress_flags"] = f"""WITH f AS ({S['page_fingerprints']})
SELECT page_id // 5 AS chain, page_id AS round, fingerprint <> lag(fingerprint) OVER w OR anchor_count > lag(anchor_count) OVER w AS progress
FROM f WINDOW w AS (PARTITION BY page_id // 5 ORDER BY page_id)"""
S["pagination_types"] = "SELECT page_id, ['load_more', 'load_more', 'link', 'link', 'load_more', NULL][page_id % 6 + 1] AS kind FROM pages"

# ---- health --------------------------------------------------------------

HISTORY = """h AS (SELECT event_type AS template_id, 'f' || (user_id % 3) AS field, event_id AS seq, CASE WHEN value > 12 THEN CAST(event_id AS VARCHAR) END AS value FROM events)"""


def flags(src: str) -> str:
    return f"""fl AS (SELECT template_id, field, seq, value, pos, pos >= 3 AND (n3 = 3 OR n5 / least(pos, 5) > 0.6) AS flagged FROM (
  SELECT *, row_number() OVER w AS pos, sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END) OVER (w ROWS 2 PRECEDING) AS n3,
    sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END) OVER (w ROWS 4 PRECEDING) AS n5 FROM {src} WINDOW w AS (PARTITION BY template_id, field ORDER BY seq)))"""


S["observations"] = DOM + """
SELECT 'nav' AS template_id, f AS field, pages.page_id AS seq, v AS value FROM pages CROSS JOIN (VALUES ('fourth', 4), ('fifth', 5), ('sixth', 6)) x(f, k)
LEFT JOIN (SELECT p.page_id, p.tag_pos, any_value(nullif(trim(e.text), '')) AS v FROM el e JOIN el p ON p.page_id = e.page_id AND p.pre = e.parent WHERE e.tag = 'a' AND p.tag = 'li' GROUP BY ALL) l
  ON l.page_id = pages.page_id AND l.tag_pos = k"""
S["health_windows"] = f"""WITH {HISTORY}
SELECT template_id, field, seq, list(value) OVER (w ROWS 9 PRECEDING) AS results,
  coalesce(list(value) FILTER (value IS NOT NULL) OVER (w ROWS UNBOUNDED PRECEDING), [])[-5:] AS samples
FROM h WINDOW w AS (PARTITION BY template_id, field ORDER BY seq)"""
S["healing_flags"] = f"WITH {HISTORY}, {flags('h')} SELECT template_id, field, seq, value, flagged FROM fl"
S["healing_flags_pages"] = S["observations"].replace("\nSELECT 'nav'", ", h AS (SELECT 'nav'", 1) + f"), {flags('h')} SELECT template_id, field, seq, flagged FROM fl"
S["cascade_flags"] = f"WITH {HISTORY}, {flags('h')} SELECT template_id, pos AS seq, round(avg(CAST(flagged AS INT)), 6) AS failing, avg(CAST(flagged AS INT)) > 0.5 AS cascade FROM fl GROUP BY 1, 2"
S["attempts_after_repair"] = """
SELECT template_id, field, CASE last % 3 WHEN 0 THEN n WHEN 1 THEN 0 ELSE n + 1 END AS attempts, CASE last % 3 WHEN 0 THEN n WHEN 1 THEN 0 ELSE n + 1 END < 3 AS can_heal
FROM (SELECT event_type AS template_id, CAST(user_id AS VARCHAR) AS field, count(*) AS n, max(event_id) AS last FROM events GROUP BY ALL)"""
S["history_after_reset"] = f"""WITH {HISTORY}, r AS (SELECT template_id, field, max(seq) AS last FROM h WHERE seq % 97 = 0 GROUP BY ALL),
k AS (SELECT h.* FROM h LEFT JOIN r USING (template_id, field) WHERE last IS NULL OR seq > last), {flags('k')} SELECT template_id, field, seq, flagged FROM fl"""


def similar(a: str, b: str) -> str:
    same = (f"len(list_filter(range(1, least(length({a}), length({b})) + 1), lambda i: substring({a}, i, 1) = substring({b}, i, 1)))")
    return f"(contains({a}, {b}) OR contains({b}, {a}) OR (abs(length({a}) - length({b})) <= 3 AND {same} >= least(length({a}), length({b})) - 2))"


S["similar_names"] = f"""SELECT p_partkey, {similar('p_name', 'y')} AS a, {similar('p_brand', 'z')} AS b
FROM (SELECT *, lower(p_type) AS y, 'Brand' || p_size AS z FROM part)"""
S["value_shapes"] = "SELECT p_partkey, ['currency', 'decimal', 'url', 'email', NULL][p_partkey % 5 + 1] AS shape FROM part"
S["healed_values"] = """
SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_partkey % 5 = 0 WHEN p_partkey % 3 = 0 THEN p_partkey % 5 = 2 ELSE true END AS ok FROM part"""

# ---- repair --------------------------------------------------------------

REPAIR = "SELECT o_orderkey AS page_id, field, new_xpath FROM orders, (VALUES {0}) v(field, new_xpath)"
S["repaired_by_class"] = REPAIR.format("('price', './/span[contains(@class,''price'')]/text()'), ('prev', '//a[contains(@class,''prev'')]/@href'), ('cost', NULL)")
S["repaired_by_pattern"] = REPAIR.format("('price', './/span[contains(@class, ''price'')]/text()'), ('prev', NULL), ('cost', './/span[contains(@class, ''price'')]/text()')")
S["fields_healed"] = """
SELECT o_orderkey AS page_id, field, new_xpath, new_confidence FROM orders, (VALUES ('price', './/span[contains(@class,''price'')]/text()', 0.7),
  ('prev', '//a[contains(@class,''prev'')]/@href', 0.7), ('cost', './/span[contains(@class, ''price'')]/text()', 0.7),
  ('lost', './/h1[@data-testid=''order-title'']', 0.98)) v(field, new_xpath, new_confidence)"""
S["records_after_repair"] = "SELECT o_orderkey AS page_id, 'Order ' || o_orderkey AS price FROM orders WHERE o_orderkey >= 100"
S["container_works"] = f"""SELECT page_id, x AS container_xpath, x = '//ul/li' AND page_id >= {LIST_BASE} AS works FROM ({SHOP_PAGES}), (VALUES ('//ul/li'), ('//ol/li')) v(x)"""

# ---- stored answers ------------------------------------------------------

O = "SELECT o_orderkey AS page_id, o_orderkey % 4 AS k, o_orderkey % 5 < 2 AS unsure FROM orders"
TYPE = "CASE k WHEN 3 THEN 'article' WHEN 0 THEN 'list' ELSE 'detail' END"
N_EL = "SELECT o_orderkey AS page_id, 20 + CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS n_el FROM orders"
FIELDS_JSON = """'{"fields": [{"name": "title", "aid": "e9", "extract": "text", "description": "t"}, {"name": "far", "aid": "e' || (page_id % 60)
  || '", "extract": "attribute", "attribute_name": "href", "description": "f"}, {"name": "bad", "aid": "e1", "extract": "html", "description": "x"}]'"""
S["fences_stripped"] = f"""WITH o AS (FROM ({O}))
SELECT page_id, 'page_type' AS prompt_kind, a AS attempt,
  concat('{{"page_type": "', {TYPE}, '", "confidence": ', CASE WHEN unsure THEN ['0.5', '0.6'][a + 1] ELSE '0.9' END, ', "reason": "r"}}') AS content
FROM o, (VALUES (0), (1)) v(a)
UNION ALL SELECT page_id, 'list_fields', 0, concat('{{"page_type": "list", "container_aid": "e', page_id % 40, '", "primary_detail_link_xpath": ',
  CASE WHEN k = 0 THEN '"//a[@data-aid]"' ELSE '" //main//a/@href "' END,
  ', "detail_link_xpath_candidates": [{{"xpath": "//ul//a/@href", "confidence": 0.6}}, {{"xpath": "//main//a/@href"}}, {{"xpath": " "}}], "pagination": {{"next_aid": "e5", "type": "Button"}}}}') FROM o
UNION ALL SELECT page_id, 'detail_fields', 0, {FIELDS_JSON} || '}}' FROM o
UNION ALL SELECT page_id, 'legacy', 0, concat({FIELDS_JSON}, ', "page_type": "', CASE WHEN k = 1 THEN 'list' ELSE 'detail' END, '"}}') FROM o
UNION ALL SELECT page_id, 'heal', 0, concat('{{"found": ', CASE WHEN k = 2 THEN 'false' ELSE 'true' END, ', "aid": "e9"}}') FROM o"""
S["page_types_parsed"] = f"""SELECT page_id, a AS attempt, {TYPE} AS page_type, CASE WHEN unsure THEN 0.5 + a / 10 ELSE 0.9 END AS confidence
FROM ({O}), (VALUES (0), (1)) v(a) WHERE k < 3"""
S["detections_picked"] = f"""SELECT page_id, {TYPE} AS page_type, CASE WHEN unsure THEN 0.6 ELSE 0.9 END AS confidence, unsure AS use_legacy FROM ({O}) WHERE k < 3"""
S["list_headers"] = f"""SELECT page_id, 'list' AS page_type, CASE WHEN page_id % 40 < n_el THEN 'e' || (page_id % 40) END AS container_aid,
  CASE WHEN k = 0 THEN '//ul//a/@href' ELSE '//main//a/@href' END AS primary, 'e5' AS next_aid, 'load_more' AS next_type FROM ({O}) JOIN ({N_EL}) USING (page_id)"""
S["list_candidates"] = f"""SELECT page_id, 0 AS ord, '//ul//a/@href' AS xpath, 0.6 AS confidence FROM ({O}) WHERE k = 0 UNION ALL SELECT page_id, 1, '//main//a/@href', 0.5 FROM ({O}) WHERE k = 0
UNION ALL SELECT page_id, 0, '//main//a/@href', 0.8 FROM ({O}) WHERE k > 0 UNION ALL SELECT page_id, 1, '//ul//a/@href', 0.6 FROM ({O}) WHERE k > 0"""
S["fields_parsed"] = f"""SELECT page_id, 0 AS ord, 'title' AS field, 'e9' AS aid, 'text' AS extract, NULL AS attribute_name FROM ({O})
UNION ALL SELECT page_id, 1, 'far', 'e' || (page_id % 60), 'attribute', 'href' FROM ({O}) JOIN ({N_EL}) USING (page_id) WHERE page_id % 60 < n_el"""
S["legacy_converted"] = f"""SELECT page_id, CASE WHEN k = 1 THEN 'list' ELSE 'detail' END AS page_type,
  CASE WHEN k = 1 AND page_id % 60 < n_el THEN 1 ELSE 0 END AS n_candidates, CASE WHEN k = 1 THEN 0 WHEN page_id % 60 < n_el THEN 2 ELSE 1 END AS n_fields
FROM ({O}) JOIN ({N_EL}) USING (page_id)"""
S["heal_answers"] = f"SELECT page_id, 'e9' AS aid, NULL AS container_aid, false AS container_changed FROM ({O}) WHERE k <> 2"

# ---- jobs ----------------------------------------------------------------

S["pages_routed"] = f"""SELECT page_id, CASE k WHEN 0 THEN 'list' ELSE 'detail' END AS flow FROM ({O}) WHERE k < 3"""
S["templates_built"] = """SELECT CAST(o_orderkey AS VARCHAR) AS template_id, field, xpath, confidence FROM orders,
  (VALUES ('title', './/h1[@data-testid=''order-title'']', 0.98), ('price', '//body/div/span[1]', 0.3)) v(field, xpath, confidence) WHERE o_orderkey % 200 = 0"""
S["archive_records"] = f"""SELECT {LIST_BASE} + o_orderkey // 200 * 10 AS seed, 'shop' || (o_orderkey // 200 % 7) || '.example.com' AS host, o_orderkey AS page_id,
  'Order ' || o_orderkey AS title, {PRICE_TEXT} AS price FROM orders"""
S["archive_export_host"] = f"""SELECT {LIST_BASE} + o_orderkey // 200 * 10 AS seed, 'shop' || (o_orderkey // 200 % 7) || '.example.com' AS host, count(*) AS n_records FROM orders GROUP BY 1, 2"""
S["detail_trail"] = """SELECT o_orderkey AS page_id, 'start' AS source, 'Order ' || o_orderkey AS title FROM orders
UNION ALL SELECT o_orderkey - 1, 'followed', 'Order ' || (o_orderkey - 1) FROM orders
WHERE o_orderkey // 200 = (o_orderkey - 1) // 200 AND o_orderkey - 1 IN (SELECT o_orderkey FROM orders)"""
S["templates_reanalysed"] = """SELECT CAST(o_orderkey AS VARCHAR) AS template_id, o_orderkey // 200 % 6 = 0 AS replaced, 2 AS n FROM orders WHERE o_orderkey % 200 = 0"""


def _doubles(name: str) -> str:
    """Literal confidences are decimals in SQL; the engine has doubles."""
    for column in ("new_confidence", "confidence"):
        if name in DECIMAL and column in S[name]:
            return f"SELECT * REPLACE (CAST({column} AS DOUBLE) AS {column}) FROM ({S[name]})"
    return S[name]


DECIMAL = {
    "selectors_generated", "selectors_by_ancestor", "selectors_chosen", "selectors_best", "fields_healed",
    "page_types_parsed", "detections_picked", "list_candidates", "templates_built",
}


def statements() -> dict[str, str]:
    import entry_queries

    return {k: _doubles(k) for k in S if k in entry_queries.QUERIES}
