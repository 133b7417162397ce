"""Queries over all starts, elements, levels and whole strings, against brute force on a small site."""

import json

import pytest

from entry_queries import QUERIES
from webcorpus.operators import shred

ORDERS = [(k, 10 + k % 3, "FOP"[k % 3], 150000.0 + k * 7000, ["1-URGENT", "5-LOW"][k % 2]) for k in [*range(0, 25), 199, 200, 201]]
PARTS = [(1, "red", "RED TIN", "Brand#1", 3, 1.0), (2, "large tin", "LARGE TIX", "Brand#2", 4, 1.0), (3, "ab", "cdefghij", "Brand#3", 5, 1.0)]
HTML = "<html><body><main><div><section><ul><li><p><b><i><u><a href='/x{0}'>t{0}</a></u></i></b></p></li></ul></section></div></main></body></html>"


@pytest.fixture(scope="module")
def site(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("site"))
    put = lambda rows, ddl, name: spark.createDataFrame(rows, ddl).write.parquet(f"{folder}/{name}.parquet")
    put(ORDERS, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string", "orders")
    put(PARTS, "p_partkey long, p_name string, p_type string, p_brand string, p_size int, p_retailprice double", "part")
    put([(i, f"https://e.com/{i}", HTML.format(i // 3)) for i in range(40)], "page_id long, url string, html string", "pages")
    return folder


def rows(spark, site, name):
    return [tuple(r) for r in QUERIES[name](spark, site).collect()]


def list_elements(spark, site):
    from entry_corpus import list_pages

    return shred.elements(shred.shred_html(list_pages(spark, site))).collect()


def test_siblings_of_every_element(spark, site):
    e = list_elements(spark, site)
    toks = lambda r: set((r.cls or "").split()) or {""}
    pairs = {
        (a.page_id, a.pre, b.pre) for a in e for b in e
        if a.page_id == b.page_id and a.parent == b.parent >= 0 and a.tag == b.tag and toks(a) & toks(b)
    }
    got = rows(spark, site, "similar_siblings")
    assert len(got) == len(set(got)) and set(got) == pairs
    kind = {(r.page_id, r.pre): r.attrs["data-kind"] for r in e if "data-kind" in r.attrs}
    counts = {}
    for page, a, b in pairs:
        if (page, a) in kind:
            key = page, kind.get((page, b), "")
            counts[key] = counts.get(key, 0) + 1
    assert {(p, v): n for p, v, n in rows(spark, site, "sibling_attribute_values")} == counts


def test_profiles_of_every_element(spark, site):
    got = {(p, n): json.loads(text) for p, n, text in rows(spark, site, "element_profiles")}
    e = {(r.page_id, r.pre): r for r in list_elements(spark, site)}
    attrs = {(r[0], r[1], r[2]): tuple(r[3:]) for r in rows(spark, site, "attribute_stability")}
    tokens = {(r[0], r[1], r[2]): tuple(r[3:]) for r in rows(spark, site, "class_token_stability")}
    assert set(got) == set(e)
    for key, x in got.items():
        r = e[key]
        assert (x["tag"], x["text_sample"]) == (r.tag, r.text.strip()[:100])
        assert [(a["attr"], a["value"], a["classification"]) for a in x.get("attributes", [])] == [(k, *attrs[(*key, k)]) for k in r.attr_names]
        assert [(t["token"], t["classification"]) for t in x.get("class_tokens", [])] == [tokens[(*key, i)] for i in range(len((r.cls or "").split()))]
        chain, up = [], r.parent
        while up >= 0:
            chain.append(e[key[0], up])
            up = chain[-1].parent
        assert [(a["tag"], [t["name"] for t in a["attributes"]]) for a in x["ancestors"]] == [(a.tag, a.attr_names) for a in chain[:10]]


def test_contexts_of_every_element(spark, site):
    from entry_corpus import order_pages

    got = {(p, n): json.loads(text) for p, n, text in rows(spark, site, "element_contexts")}
    pages = {}
    for r in shred.elements(shred.shred_html(order_pages(spark, site))).collect():
        pages.setdefault(r.page_id, {})[r.pre] = r

    def shown(r):
        out = []
        for k in r.attr_names:
            if k == "class":
                out.append({"name": k, "tokens": [{"token": t, "classification": "stable"} for t in r.cls.split()]})
            else:
                out.append({"name": k, "value": r.attrs[k][:80], "classification": "stable" if k == "data-testid" else "unknown"})
        return {"tag": r.tag, "attributes": out}

    assert set(got) == {(p, n) for p, page in pages.items() for n in page}
    for (p, n), x in got.items():
        page, r = pages[p], pages[p][n]
        up, chain = r.parent, []
        while up >= 0:
            chain.append(page[up])
            up = page[up].parent
        beside = [s for s in page.values() if s.parent == r.parent and s.pre != n and abs(s.sib_pos - r.sib_pos) <= 3]
        below = [s for s in page.values() if n < s.pre <= r.last and s.depth <= r.depth + 2][:8]
        want = {
            "element": shown(r), "text": " ".join(r.text.split())[:100], "ancestors": [shown(a) for a in chain[:6]],
            "siblings": [{"place": s.sib_pos - r.sib_pos, "element": shown(s)} for s in beside], "descendants": [shown(s) for s in below],
        }
        if r.parent < 0:
            del want["siblings"]
        assert x == want


def test_ten_levels_of_every_element(spark, site):
    tags = "html body main div section ul li p b i u a".split()
    got = {(p, n): list(t) for p, n, t in rows(spark, site, "ancestor_chains")}
    assert got == {(p, n): tags[:n][::-1][:10] for p in range(40) for n in range(len(tags))}


def test_whole_fingerprints(spark, site):
    prints = {r.page_id: r.fingerprint for r in QUERIES["page_fingerprints"](spark, site).collect()}
    want = {(i // 5, i, None if i % 5 == 0 else prints[i] != prints[i - 1]) for i in range(40)}
    assert set(rows(spark, site, "progress_flags")) == want
    assert any(a[0] == b[0] and a != b for a in prints.values() for b in prints.values())


def test_whole_names(spark, site):
    def similar(a, b):
        same = sum(x == y for x, y in zip(a, b))
        return a in b or b in a or (abs(len(a) - len(b)) <= 3 and same >= min(len(a), len(b)) - 2)

    want = {(k, similar(n, t.lower()), similar(b, f"Brand{size}")) for k, n, t, b, size, _ in PARTS}
    assert set(rows(spark, site, "similar_names")) == want and len({w[1] for w in want}) == 2


def test_routes_and_trails_from_every_page(spark, site):
    keys = [o[0] for o in ORDERS]
    assert sorted(rows(spark, site, "pages_routed")) == sorted((k, "list" if k % 4 == 0 else "detail") for k in keys if k % 4 != 3)
    follow = [k - 1 for k in keys if k - 1 in keys and k // 200 == (k - 1) // 200]
    want = [(k, "start", f"Order {k}") for k in keys] + [(k, "followed", f"Order {k}") for k in follow]
    assert sorted(rows(spark, site, "detail_trail")) == sorted(want)


def test_pages_are_shredded_once(spark, site):
    """What the elements are read for several times does not shred the pages again."""
    for name in ("similar_siblings", "sibling_attribute_values", "selectors_by_ancestor", "element_profiles", "detail_trail", "legacy_converted", "export_documents", "link_scores"):
        plan = QUERIES[name](spark, site)._jdf.queryExecution().optimizedPlan().toString()
        assert "_shred_batches" not in plan, name


def test_what_is_read_twice_is_made_once(spark, site):
    """Records of start pages are extracted once; broken selectors of a page share its class tokens and texts."""
    made = lambda name, what: QUERIES[name](spark, site)._jdf.queryExecution().optimizedPlan().toString().count(what)
    assert made("detail_trail", "map_from_arrays(") == 1
    # in the page row, before the broken selectors join it
    assert made("repaired_by_class", "AS _tokens#") == 1 and made("repaired_by_pattern", "AS _own#") == 1
