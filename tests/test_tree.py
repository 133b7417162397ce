import random
import time
import tracemalloc

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from webcorpus.operators import clean, extract, induce, intervals, links, selectors, shred, siblings, stability

TAGS = ["div", "p", "b", "ul", "li", "table", "tr", "td", "br", "script"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.sampled_from([f"<{t}>" for t in TAGS] + [f"</{t}>" for t in TAGS]), st.sampled_from(["x", " ", "<", "<!-- c -->", "&amp;"])), max_size=40))
def test_intervals_nest(parts):
    nodes, texts, _ = shred.shred_page("".join(parts))
    for n in nodes:
        assert n["parent"] < n["pre"] <= n["last"]
        if n["parent"] >= 0:
            assert n["last"] <= nodes[n["parent"]]["last"] and n["depth"] == nodes[n["parent"]]["depth"] + 1
        assert 0 <= n["c0"] <= n["c1"] <= sum(len(t["text"]) for t in texts)


def test_malformed_markup():
    nodes, texts, _ = shred.shred_page("<body><p><b>a<p>b</b>c<ul><li>1<li>2</ul><script>var x='</p>'</script>")
    assert [(n["tag"], n["parent"]) for n in nodes] == [("body", -1), ("p", 0), ("b", 1), ("p", 0), ("ul", 0), ("li", 4), ("li", 4), ("script", 0)]
    assert "".join(t["text"] for t in texts) == "abc12var x='</p>'"


def test_cleaning_rules(pages):
    body = "<p><span></span>hello</p><div><img></div><div><p><i></i></p></div><p hidden>x</p>tail<a title='{}'>k</a>"
    df = pages("<html><body>" + body.format("y" * 101) + "</body></html>")
    html = clean.clean_html(df).first().html
    assert html == f'<html><body><div><img></div><a title="{"y" * 100}...">k</a></body></html>'
    kept = clean.clean_html(df, keep_tails=True).first().html
    assert "<p>hello</p>" in kept and "tail" in kept


def test_chrome_threshold(pages):
    make = lambda n: f"<html><body><nav>menu</nav><p>{'z' * n}</p></body></html>"
    dom = clean.drop_chrome(shred.shred_html(pages(make(499), make(500))))
    assert [r.t for r in dom.orderBy("page_id").select(clean.alive_text().alias("t")).collect()] == ["menu" + "z" * 499, "z" * 500]


def cards():
    items = []
    for i in range(10):
        cls = "card css-3fJ8kL nav-item" + (" sale" if i < 2 else "") + (" featured" if i < 5 else "")
        items.append(f'<li class="{cls}" data-sku="S{chr(97 + i)}." data-kind="k.{i % 2}" data-tier="t.{i % 4}" data-unit="pc." data-testid="q{i}" jsname="j">x</li>')
    return "<html><body><ul>" + "".join(items) + "</ul><h1 data-q='a.'>one</h1></body></html>"


def test_stability_labels(pages):
    e = shred.shred_html(pages(cards()))
    got = {r.attr: r.classification for r in stability.classify_attributes(e).filter("pre = 3").collect()}
    assert got == {"class": "random", "data-sku": "business", "data-kind": "business_category", "data-tier": "random",
                   "data-unit": "stable", "data-testid": "stable", "jsname": "random"}
    tok = {r.token: r.classification for r in stability.classify_class_tokens(e).filter("pre = 3").collect()}
    assert tok == {"card": "stable", "sale": "conditional", "featured": "stable", "css-3fJ8kL": "random", "nav-item": "random"}
    assert stability.classify_attributes(e).filter("attr = 'data-q'").first().classification == "unknown"


def brute_totals(rows):
    out = {}
    for pid, pre, parent, tag, toks in rows:
        out[(pid, pre)] = sum(1 for q, _, par, t, o in rows if (q, par, t) == (pid, parent, tag) and (set(toks) & set(o) or (not toks and not o)))
    return out


def test_sibling_counts_equal_pairs(spark, pages):
    rng = random.Random(3)
    item = lambda i, names, most: "<li" + (f' class="{" ".join(rng.sample(names, rng.randint(1, most)))} u{i}"' if rng.random() < 0.8 else "") + f" data-k='{i % 3}'" * (i % 4 > 0) + ">"
    lists = ["".join(item(i, names, most) for i in range(40)) for names, most in (("abcdefg", 3), ("ab", 2), ("a", 1))]
    dom = shred.shred_html(pages(*["<ul>" + x + "</ul>" for x in lists], "<p class=' '>", ""))
    e = shred.elements(dom).select("page_id", "pre", "parent", "tag", "cls", "attrs").collect()
    rows = [(r.page_id, r.pre, r.parent, r.tag, (r.cls or "").split()) for r in e]
    attrs = {(r.page_id, r.pre): r.attrs for r in e}
    totals = brute_totals(rows)

    def near(page, pre):
        _, _, parent, tag, toks = next(r for r in rows if r[:2] == (page, pre))
        return [q for p, q, par, t, o in rows if parent >= 0 and (p, par, t) == (page, parent, tag) and (set(toks) & set(o) or (not toks and not o))]

    for r in siblings.sibling_counts(dom, "attributes").collect():
        like = [attrs[r.page_id, q] for q in near(r.page_id, r.pre)]
        values = [a[r.attr] for a in like if r.attr in a]
        if len(like) > 1:
            assert (r.total, r.present, r.n_values, r.has_blank) == (totals[r.page_id, r.pre], len(values), len(set(values)), "" in values)
        else:
            assert r.total == 0
    got = siblings.sibling_counts(dom, "tokens").collect()
    assert len(got) == sum(len(r[4]) for r in rows)
    tokens = {r[:2]: r[4] for r in rows}
    for r in got:
        like = near(r.page_id, r.pre)
        assert (r.total, r.freq) == ((len(like), sum(r.token in tokens[r.page_id, q] for q in like)) if len(like) > 1 else (0, 0))
    ctx = spark.createDataFrame([(0, 5, 3), (0, 6, -1), (0, 7, 9_999)], "page_id long, pre int, ctx_pre int")
    some = {(r.pre, r.attr): r.total for r in siblings.sibling_counts(dom, "attributes", ctx).collect()}
    assert some == {(p, a): totals[0, 3] if p == 5 and totals[0, 3] > 1 else 0 for p in (5, 6, 7) for a in attrs[0, p]}


def test_deep_pages_take_linear_space(pages):
    depth = 60_000
    html = "<div>" * depth + "x" + "</div>" * depth
    dom = shred.shred_html(pages(html, "<div><p><b></b></p><i>a</i></div>")).cache()
    last = dom.select("page_id", F.size("nodes").alias("n"), F.get("nodes", F.lit(7))["depth"].alias("d")).collect()
    assert {r.page_id: (r.n, r.d) for r in last} == {0: (depth, 7), 1: (4, None)}
    left = clean.drop_empty(dom).select("page_id", "alive").collect()
    assert {r.page_id: len(r.alive) for r in left} == {0: depth, 1: 2}
    gone = clean.drop_empty(shred.shred_html(pages("<p>a</p>" + html.replace("x", "")))).select("alive", "talive").first()
    assert (gone.alive, gone.talive) == ([0], [0])


def test_attributes_of_a_batch_are_made_at_once():
    made = shred._attribute_arrays([{"a": "1", "b": ""}, {}, {"c": "x"}])
    assert made["attrs"].to_pylist() == [[("a", "1"), ("b", "")], [], [("c", "x")]]
    assert made["attr_names"].to_pylist() == [["a", "b"], [], ["c"]]


def test_elements_are_no_records_while_a_page_is_shredded():
    """A page of many elements takes little memory: its fields are columns, and positions count within parent and tag."""
    html = "<ul>" + "<li>a<b>b</b><!-- c -->c</li>" * 20_000 + "</ul>"
    batch = pa.RecordBatch.from_pydict({"page_id": [1], "url": ["u"], "html": [html]})
    tracemalloc.start()
    (out,) = shred._shred_batches(iter([batch]))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most <= 1400 * 40_001
    nodes = out.column("nodes").to_pylist()[0]
    assert [(n["tag"], n["parent"], n["ord"], n["sib_pos"], n["tag_pos"], n["tag_n"]) for n in nodes[:3]] == [
        ("ul", -1, 1, 1, 1, 1), ("li", 0, 1, 1, 1, 20_000), ("b", 1, 1, 1, 1, 1),
    ]
    assert nodes[-2] | {"pre": 39_999, "last": 40_000, "parent": 0, "ord": 20_000, "sib_pos": 20_000, "tag_pos": 20_000, "tag_n": 20_000} == nodes[-2]
    assert [(t["after"], t["after_comment"], t["text"]) for t in out.column("texts").to_pylist()[0][-3:]] == [(-1, False, "a"), (-1, False, "b"), (40_000, True, "c")]
    assert out.column("comments").to_pylist()[0][-1] == {"parent": 39_999, "ord": 2, "tail": 59_999}
    open_comment = shred.shred_page("<p><!-- a</p><b><!doctype x>")
    assert [n["ord"] for n in open_comment[0]] == [1, 2] and open_comment[2] == [{"parent": 0, "ord": 1, "tail": -1}]


def test_tags_are_taken_apart_once(monkeypatch):
    """Pages repeat their tags; what looks like a tag is read where it stands, since a quote may hold brackets."""
    seen, real = [], shred._attributes
    monkeypatch.setattr(shred, "_attributes", lambda raw: seen.append(raw) or real(raw))
    html = "<ul>" + "<li class='a'><a href='/x'>t</a></li>" * 50 + "</ul><p title='<b>'>x<b a=\"1>2\">y<"
    batch = pa.RecordBatch.from_pydict({"page_id": [1, 2, 3], "url": ["u"] * 3, "html": [html, html, "<p title='<b"]})
    (out,) = shred._shred_batches(iter([batch]))
    assert len(seen) == len(set(seen)) == 5
    one, two, cut = out.column("nodes").to_pylist()
    assert one == two and cut == [] and [t["text"] for t in out.column("texts").to_pylist()[2]] == ["<p title='<b"]
    assert [(n["tag"], n["attrs"], n["last"]) for n in one[-2:]] == [("p", [("title", "<b>")], 102), ("b", [("a", "1>2")], 102)]
    assert [t["text"] for t in out.column("texts").to_pylist()[0][-2:]] == ["x", "y<"]
    odd = ["<p a='x", "<b>'>", '<a"b>', "</a\"b>c\">", "<br/>", "<scripts>", "<script>1<2</script>", "<>", "</>", "<!-- <p> -->", "&lt;<"]
    for k in range(len(odd)):
        page = "".join(odd[k:] + odd[:k])
        tokens = [t for t in shred.TOKEN.findall(page) if t[6] and not t[5] or t[2]]
        assert [n["tag"] for n in shred.shred_page(page)[0]] == [(t[6] or t[2]).lower() for t in tokens]


def test_intervals_equal_ancestors(spark):
    rng = random.Random(6)
    rows = []
    for page in range(60):
        parent = [-1] + [rng.randint(-1, i - 1) for i in range(1, rng.randint(1, 30))]
        up = lambda i: [] if i < 0 else [i, *up(parent[i])]  # noqa: B023
        order = sorted(range(len(parent)), key=lambda i: up(i)[::-1])
        number = {old: new for new, old in enumerate(order)}
        above = {number[i]: {number[a] for a in up(i)} for i in range(len(parent))}
        last = [max(j for j in above if i in above[j]) for i in range(len(parent))]
        marked = [rng.randrange(len(parent)) for _ in range(rng.randint(0, 6))]
        rows.append((page, last, marked, sorted(set().union(*[above[m] for m in marked])), sorted(m for m in set(marked) if not any(a in above[m] - {m} for a in marked))))
    df = spark.createDataFrame(rows, "page int, last array<int>, marked array<int>, h array<int>, o array<int>")
    for r in df.select("h", "o", intervals.holding("last", "marked").alias("x"), intervals.outermost("last", "marked").alias("y")).collect():
        assert (r.x, r.y) == (r.h, r.o)


def test_cleaning_keeps_no_page_rows_waiting_for_python(pages):
    left = clean.drop_empty(shred.shred_html(pages("<p>a</p><p></p>")))
    assert "EvalPython" not in left._jdf.queryExecution().executedPlan().toString()


def test_choose_promotes_valid_fallback(spark, pages):
    dom = shred.shred_html(pages("<html><body><div><span>a</span><span>b</span></div></body></html>")).cache()
    ddl = "page_id long, pre int, field string, extract string, container_pre int, xpath string, fallback_xpath string, confidence double"
    rows = [(0, 4, "page", "text", None, ".//span[1]", ".//span[2]", 0.9), (0, 4, "item", "text", 2, ".//span", ".//span[2]", 0.9),
            (0, 4, "none", "text", None, "//p", "foo(", 0.9)]
    got = {r.field: (r.xpath, r.confidence) for r in induce.choose_selector(dom, spark.createDataFrame(rows, ddl)).collect()}
    assert got == {"page": (".//span[2]", 0.75), "item": (".//span[2]", 0.75), "none": (None, None)}


def test_extraction_rules(spark, pages):
    long = "w" * 118
    html = (f"<html><body><div><p> </p><p>second</p></div><section><p>a</p><p>a</p><p>b</p><p>a</p></section>"
            f"<em>Copyright X<i> and more</i></em><q>{'v' * 10}<i>{long}</i></q><s><i>{'v' * 10}</i></s></body></html>")
    ddl = "template_id string, ord int, field string, description string, xpath string, fallback_xpath string, extract string, attribute_name string"
    rows = [("t", 0, "first", "", "//div/p", None, "text", None), ("t", 1, "body", "", "//section/p", None, "text", None),
            ("t", 2, "content", "", "//em/text()", None, "text", None), ("t", 3, "article", "", "//q/text()", None, "text", None),
            ("t", 4, "spare", "", "//nope", "//i", "text", None), ("t", 5, "bad", "", "//p[last()]", None, "text", None),
            ("t", 6, "own", "", "//s/text()", None, "text", None)]
    dom = shred.shred_html(pages(html)).withColumn("template_id", F.lit("t"))
    data = extract.extract_detail(dom, extract.compile_templates(spark.createDataFrame(rows, ddl))).first().data
    assert data == {"first": None, "body": "a\nb\na", "content": "Copyright X and more", "article": "v" * 10 + long,
                    "spare": "and more", "bad": None, "own": "v" * 10}


def test_list_extraction(spark, pages):
    dom = shred.shred_html(pages("<ul><li><b>1</b><li><b>2</b><li>3</ul>", "<p>none</p>")).withColumn("template_id", F.lit("t"))
    sel = spark.createDataFrame([("t", 0, "n", "", ".//b", None, "text", None)], "template_id string, ord int, field string, description string, xpath string, fallback_xpath string, extract string, attribute_name string")
    tpl = spark.createDataFrame([("t", "list", "//ul/li")], "template_id string, page_type string, container_xpath string")
    rows = extract.extract_list(dom, extract.compile_templates(sel, tpl)).orderBy("page_id", "item").collect()
    assert [(r.page_id, r.item, r.data["n"]) for r in rows] == [(0, 0, "1"), (0, 1, "2"), (0, 2, None)]


def test_links_with_more_article_like_paths_score_higher(spark, pages):
    menu = "".join(f"<li><a href='/{w}'>{w}</a></li>" for w in ("imprint", "contact", "login"))
    cards = "".join(f"<section><a href='/recipes/soup-{i}'>soup {i}</a></section>" for i in range(40, 46))
    dom = shred.shred_html(pages(f"<html><body><ul>{menu}</ul>{cards}</body></html>", url="https://kitchen.example.org/all/"))
    cand = spark.createDataFrame([(7, "//ul//a/@href"), (8, "//section/a/@href")], "cand int, xpath string")
    found = links.extract_links(dom, cand).withColumn("ord", F.struct("page_id", "pre")).select("cand", "ord", "target")
    scores = links.score_link_candidates(found, cand, 4)
    score = {r.cand: r.score for r in scores.collect()}
    assert 0 <= score[7] < score[8] <= 1
    chosen = [r.url for r in links.select_links(found, scores, 4).collect()]
    assert len(chosen) == 4 and all("/recipes/" in t for t in chosen)


def test_relative_selectors_start_at_the_implied_root(spark, pages):
    dom = shred.shred_html(pages("<p>a</p><h1>A</h1>", "<head></head><body><h1>B</h1></body>", "<html><body><h1>C</h1></body></html>"))
    asked = spark.createDataFrame([(".//h1",), ("//h1",), (".//html",)], "xpath string")
    got = {(r.page_id, r.xpath, r.value) for r in selectors.match_selectors(dom, asked).collect()}
    assert got == {(i, x, v) for i, v in enumerate("ABC") for x in (".//h1", "//h1")}


def test_links_start_at_the_base_element(spark, pages):
    page = "<html><head><base target=x><base href='/shop/x/'></head><body><a href='a?q=1'>1</a><a href='/b' rel=next>2</a></body></html>"
    df = pages(page, "<a href='c'>3</a>", url="https://ex.com/a/")
    assert sorted(r.dst for r in links.link_edges(df).collect()) == ["https://ex.com/a/c", "https://ex.com/b", "https://ex.com/shop/x/a?q=1"]
    asked = spark.createDataFrame([("//a",)], "xpath string")
    got = links.extract_links(shred.shred_html(df), asked).orderBy("page_id", "pre").collect()
    assert [r.target for r in got] == ["https://ex.com/shop/x/a?q=1", "https://ex.com/b", "https://ex.com/a/c"]


def test_more_selectors_than_a_block(spark, pages, monkeypatch):
    monkeypatch.setattr(selectors, "UNKEYED_BLOCK", 3)
    dom = shred.shred_html(pages("<html><body><p>x</p><p>y</p></body></html>"))
    asked = spark.createDataFrame([(f"//p[{i}]",) for i in range(1, 20)], "xpath string")
    assert sorted(r.xpath for r in selectors.match_selectors(dom, asked).collect()) == ["//p[1]", "//p[2]"]
    assert sum(r.n for r in selectors.test_unique(dom, asked).collect()) == 2


def test_list_fields_may_mix_relative_and_absolute_options(spark, pages):
    dom = shred.shred_html(pages("<html><body><div><b>G</b></div><li><i>1</i></li><li><u>k</u><i>2</i></li></body></html>"))
    rows = [("t", 0, "a", ".//u", "//div/b"), ("t", 1, "b", "//zz", ".//i")]
    sel = spark.createDataFrame(rows, "template_id string, ord int, field string, xpath string, fallback_xpath string")
    sel = sel.selectExpr("*", "'' AS description", "'text' AS extract", "CAST(NULL AS STRING) AS attribute_name", "0.9D AS confidence")
    templates = spark.createDataFrame([("t", "list", "//li")], "template_id string, page_type string, container_xpath string")
    out = extract.extract_list(dom.selectExpr("*", "'t' AS template_id"), extract.compile_templates(sel, templates))
    assert [(r.data["a"], r.data["b"]) for r in out.orderBy("item").collect()] == [("G", "1"), ("k", "2")]


def test_selector_plan_has_no_shuffle(spark, pages):
    dom = shred.shred_html(pages("<p>x</p>"))
    out = selectors.match_selectors(dom, spark.createDataFrame([("//p",)], "xpath string"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_labels_of_an_element_are_made_once(spark, pages):
    """Contexts and profiles look at an element from many others, and attributes and tokens are counted in one reading."""
    dom = shred.shred_html(pages(cards()))
    e = shred.elements(dom)
    plan = lambda df: df._jdf.queryExecution().analyzed().toString()
    # two for an attribute, one for a token
    assert plan(stability.dom_context(dom, e)).count("RLIKE") == 3
    made = plan(stability.classify_elements(dom, e, e))  # the pages are shredded by another function
    assert made.count("MapInArrow run(") == 1
    both = siblings.sibling_counts(dom, "both")
    for kind, some in (("attributes", "attr IS NOT NULL"), ("tokens", "token IS NOT NULL")):
        rows = siblings.sibling_counts(dom, kind)
        assert sorted(map(str, both.filter(some).select(rows.columns).collect())) == sorted(map(str, rows.collect()))


def test_shared_candidates_are_tested_once(spark, pages):
    """Targets of one family have the same candidates: the work does not grow with the square of a page."""
    n = 6_000
    html = "<html><body><div id='m|'>" + "<p>x</p>" * n + "<p|5>y</p|5></div><div class='only'><p>z</p><i>i</i></div></body></html>"
    dom = shred.shred_html(pages(html)).cache()
    t = shred.elements(dom).filter("tag LIKE 'p%' OR tag = 'i'").select("page_id", "pre", F.col("tag").alias("field"), F.lit("text").alias("extract"))
    t = t.withColumn("container_pre", F.when((F.col("field") == "p") & (F.col("pre") % 2 == 0), 2)).withColumn("attribute_name", F.lit(None).cast("string"))
    assert t.count() == n + 3
    start = time.time()
    got = {(r.field, r.xpath): r.n for r in induce.ancestor_selectors(dom, t).groupBy("field", "xpath").agg(F.count("*").alias("n")).collect()}
    assert time.time() - start < 30
    assert got == {("p", None): n, ("p|5", None): 1, ("p", ".//*[contains(@class, 'only')]//p"): 1, ("i", ".//*[contains(@class, 'only')]//i"): 1}
