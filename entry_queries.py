"""Registered queries: each runs one operator over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entry_corpus import LIST_BASE, list_pages, order_pages, read, shop_pages
from webcorpus.functions import text as tx
from webcorpus.functions import urls as u
from webcorpus.operators import clean, links, shred, tokens
from webcorpus.session import tune, written
from webcorpus.sources import tables

QUERIES = {}


def query(fn):
    def run(spark, sf_dir: str) -> DataFrame:
        return fn(tune(spark), sf_dir)

    QUERIES[fn.__name__] = run
    return fn


def big(c: str):
    return F.col(c).cast("bigint").alias(c)


# ---- sources -------------------------------------------------------------

@query
def read_pages(spark, d):
    p = tables.read_pages(spark, f"{d}/pages.parquet")
    return p.select("page_id", "url", F.length("html").cast("bigint").alias("chars"))


def site_maps(spark, d):
    """One sitemap per fifty pages; every fourth is cut off and so not well-formed."""
    p = read(spark, d, "pages").selectExpr("page_id DIV 50 AS site", "page_id", "url")
    g = p.groupBy("site").agg(F.array_sort(F.collect_list(F.struct("page_id", "url"))).alias("u"))
    one = F.transform("u", lambda x: F.concat(F.lit("<url><loc> "), F.replace(x["url"], F.lit("&"), F.lit("&amp;")), F.lit(" </loc></url>")))
    tail = F.when(F.col("site") % 4 == 3, F.lit("")).otherwise(F.lit("</urlset>"))
    xml = F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), F.array_join(one, ""), tail)
    return g.select("site", F.lit("https://example.com").alias("base_url"), xml.alias("xml"))


@query
def sitemap_urls(spark, d):
    from webcorpus.operators.graph import parse_sitemaps

    return parse_sitemaps(site_maps(spark, d)).select("site", big("ord"), "url")


@query
def sitemap_scope(spark, d):
    from webcorpus.operators.graph import filter_sitemap_scope

    return filter_sitemap_scope(read(spark, d, "pages").select("page_id", "url"), "https://x.example.com/en/")


# ---- urls ----------------------------------------------------------------

@query
def url_normalize(spark, d):
    return read(spark, d, "pages").select(
        "page_id", u.normalize_url(F.col("url")).alias("full_url"), u.normalize_url(F.col("url"), None, False).alias("no_query")
    )


@query
def url_resolve(spark, d):
    return tokens.anchors(read(spark, d, "pages")).select(
        "page_id", big("ord"), u.resolve_url(F.col("url"), F.col("href")).alias("absolute"),
        u.resolve_url(F.col("url"), F.concat(F.lit("../x/./"), F.regexp_replace("href", "^/", ""))).alias("dotted"),
    )


@query
def url_blocked(spark, d):
    href = F.when(F.col("ord") % 3 == 0, F.concat(F.lit("JavaScript:"), F.col("href"))).when(F.col("ord") % 3 == 1, F.concat(F.lit("#"), F.col("href"))).otherwise(F.col("href"))
    return tokens.anchors(read(spark, d, "pages")).select("page_id", big("ord"), u.is_blocked_href(href).alias("blocked"))


@query
def url_domain(spark, d):
    url = F.col("url")
    return read(spark, d, "pages").select(
        "page_id", u.get_domain(url).alias("domain"), u.is_same_domain(url, F.lit("M.therou.example.com")).alias("same"),
        u.is_basic_valid(url).alias("valid"), u.parent_path(url).alias("parent"), u.path_segments(url).alias("segments"),
    )


@query
def url_increment(spark, d):
    return read(spark, d, "pages").select("page_id", F.explode(u.increment_page_param(F.col("url"))).alias("next_url"))


@query
def url_valid_links(spark, d):
    p = tokens.anchors(order_pages(spark, d))
    return p.select("page_id", big("ord"), u.is_basic_valid(u.link_url(F.col("href"), F.col("url"))).alias("valid"))


# ---- flat markup ---------------------------------------------------------

@query
def token_counts(spark, d):
    t = tokens.tokenize_html(read(spark, d, "pages"))
    return t.groupBy("page_id", "kind", "tag").agg(F.count("*").alias("n"), F.sum(F.length("token")).alias("chars"))


@query
def comments_dropped(spark, d):
    return tokens.drop_comments(read(spark, d, "pages")).select("page_id", F.md5("html").alias("digest"))


@query
def pages_needing_render(spark, d):
    return tokens.needs_render(read(spark, d, "pages")).select("page_id", "url", big("text_chars"))


@query
def page_fingerprints(spark, d):
    return tokens.page_fingerprint(read(spark, d, "pages"))


# ---- tree ----------------------------------------------------------------

def dom(spark, d):
    return shred.shred_html(read(spark, d, "pages"))


@query
def element_table(spark, d):
    above = lambda n: F.reverse(shred.nearest_ancestors(n["pre"], n["depth"])).cast("array<bigint>")
    e = shred.elements(dom(spark, d).withColumn("nodes", F.transform("nodes", lambda n: n.withField("anc", above(n)))))
    ints = ["pre", "last", "parent", "depth", "sib_pos", "tag_pos", "tag_n"]
    return e.select("page_id", *[big(c) for c in ints], "tag", "cls", F.md5("text").alias("text_digest"), "anc")


@query
def element_table_shop(spark, d):
    e = shred.elements(shred.shred_html(list_pages(spark, d)))
    return e.select("page_id", big("pre"), big("last"), big("parent"), "tag", "cls", "text")


@query
def text_node_table(spark, d):
    return shred.text_nodes(dom(spark, d)).select("page_id", big("tord"), big("parent"), big("after"), F.md5("text").alias("digest"))


def left_over(dm: DataFrame) -> DataFrame:
    return dm.select("page_id", F.size("alive").cast("bigint").alias("n_elements"), F.md5(clean.alive_text()).alias("digest"))


@query
def subtrees_dropped(spark, d):
    return left_over(clean.drop_subtrees(dom(spark, d), lambda n: n["tag"].isin("ul", "h1", "div")))


@query
def subtrees_dropped_keep_tails(spark, d):
    return left_over(clean.drop_subtrees(shred.shred_html(order_pages(spark, d)), lambda n: n["tag"].isin("b", "span"), keep_tails=True))


@query
def noise_dropped(spark, d):
    return left_over(clean.drop_noise_tags(dom(spark, d)))


@query
def hidden_dropped(spark, d):
    return left_over(clean.drop_hidden(shred.shred_html(order_pages(spark, d))))


@query
def chrome_dropped(spark, d):
    return left_over(clean.drop_chrome(dom(spark, d)))


@query
def empty_dropped(spark, d):
    return left_over(clean.drop_empty(clean.drop_comment_nodes(shred.shred_html(order_pages(spark, d)))))


@query
def comment_nodes_dropped(spark, d):
    return left_over(clean.drop_comment_nodes(dom(spark, d)))


@query
def attributes_sanitized(spark, d):
    """Attributes taken from whole document texts, so that many are too long."""
    q = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;"))
    html = F.concat(F.lit('<p style="x" title="'), q(F.col("text")), F.lit('"><img src="data:image/svg+xml,'), q(F.col("source")), F.lit('">'))
    p = read(spark, d, "documents").select(F.col("doc_id").alias("page_id"), F.lit("https://x.example.com/").alias("url"), html.alias("html"))
    e = shred.elements(clean.sanitize_attrs(shred.shred_html(p)))
    return e.select("page_id", big("pre"), F.map_keys("attrs").alias("names"), F.try_element_at("attrs", F.lit("title")).alias("title"), F.try_element_at("attrs", F.lit("src")).alias("src"))


@query
def repeating_groups(spark, d):
    return clean.repeating_groups(dom(spark, d)).select("page_id", big("parent"), "tag", "cls", "n")


@query
def repeats_truncated(spark, d):
    """A page of all orders of one archive year, cut to its budget."""
    p = clean.truncate_repeats(shred.shred_html(list_pages(spark, d)), max_html=2500)
    return p.select("page_id", F.length("html").cast("bigint").alias("chars"), F.md5("html").alias("digest"))


@query
def html_rendered(spark, d):
    p = clean.render_html(shred.shred_html(list_pages(spark, d)), annotate=False)
    return p.select("page_id", "html")


@query
def html_annotated(spark, d):
    p = clean.render_html(shred.shred_html(order_pages(spark, d)))
    return p.select("page_id", F.regexp_count("html", F.lit("data-aid")).cast("bigint").alias("n"), F.regexp_extract("html", r'<h1[^>]*data-aid="([^"]*)"', 1).alias("h1_aid"))


@query
def pages_cleaned(spark, d):
    p = clean.clean_html(order_pages(spark, d), min_text=20)
    return p.select("page_id", "html")


@query
def aid_resolved(spark, d):
    e = shred.elements(dom(spark, d))
    # every second number up to twice the elements of a page, so half of the references name nothing
    sizes = dom(spark, d).select("page_id", F.size("nodes").alias("n"))
    refs = sizes.select("page_id", F.explode(F.transform(F.sequence(F.lit(0), 2 * F.col("n"), F.lit(2)), lambda i: F.concat(F.lit("e"), i))).alias("aid"))
    return clean.resolve_aid(refs, e).select("page_id", "aid", "tag", big("pre"))


@query
def element_texts(spark, d):
    e = shred.elements(dom(spark, d))
    return e.select("page_id", big("pre"), tx.element_text(F.col("text")).alias("sample"), tx.element_text(F.col("text"), 100, False).alias("plain"))


@query
def text_contents(spark, d):
    return clean.text_content(shred.elements(dom(spark, d))).select("page_id", big("pre"), F.md5("text").alias("digest"))


@query
def similar_siblings(spark, d):
    """Siblings of every element."""
    e = shred.elements(written_lists(spark, d))
    return clean.similar_siblings(e, e).select("page_id", big("pre"), big("sib_pre"))


# ---- flagship ------------------------------------------------------------

@query
def host_link_profile(spark, d):
    """Per host: pages, links, distinct targets and the dominant URL pattern of its pages."""
    p = read(spark, d, "pages")
    host = u.get_domain(F.col("url")).alias("host")
    e = links.link_edges(p).groupBy(host_of("src"), "dst").agg(F.count("*").alias("n"))
    per_host = e.groupBy("host").agg(F.sum("n").alias("n_links"), F.count("*").alias("n_targets"))
    own = p.select(host, F.col("page_id").alias("ord"), u.normalize_url(F.col("url")).alias("url"))
    pat = links.url_patterns(own, ["host"])
    top = pat.groupBy("host").agg(
        F.sum("n").alias("n_pages"), F.min(F.struct((-F.col("n")).alias("k"), "pattern")).alias("t")
    )
    return top.join(per_host, "host", "left").select(
        "host", "n_pages", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_targets", F.lit(0)).alias("n_targets"),
        F.col("t.pattern").alias("top_pattern"), (-F.col("t.k")).alias("top_n"),
    )


def host_of(c: str):
    return u.get_domain(F.col(c)).alias("host")


# ---- stability -----------------------------------------------------------

from webcorpus.operators import extract, heal, health, induce, paginate, responses, selectors, stability  # noqa: E402
from webcorpus.plans import jobs  # noqa: E402


def shop_lists(spark, d):
    return shred.shred_html(list_pages(spark, d))


def shop_orders(spark, d):
    return shred.shred_html(order_pages(spark, d))


def written_lists(spark, d):
    """For queries that read the elements more than once: pages are shredded once."""
    return written(shop_lists(spark, d))


def written_orders(spark, d):
    return written(shop_orders(spark, d))


@query
def random_tokens(spark, d):
    w = read(spark, d, "documents").select("lang", F.explode(F.split(F.regexp_replace("text", r"[^A-Za-z0-9_\-]+", " "), " ")).alias("w"))
    return w.filter("w <> ''").groupBy("lang", tx.is_random_token(F.col("w")).alias("is_random")).agg(F.count("*").alias("n"), F.countDistinct("w").alias("n_words"))


def attribute_rows(spark, d):
    e = shred.elements(shop_lists(spark, d)).unionByName(shred.elements(shop_orders(spark, d)))
    return e.select("page_id", "pre", F.explode("attrs").alias("attr", "value"))


@query
def single_attributes(spark, d):
    a = attribute_rows(spark, d)
    return a.groupBy("attr", stability.classify_single_attribute(F.col("attr"), F.col("value")).alias("label")).agg(F.count("*").alias("n"))


@query
def attribute_stability(spark, d):
    c = stability.classify_attributes(shop_lists(spark, d))
    return c.select("page_id", big("pre"), "attr", "value", "classification")


@query
def class_token_stability(spark, d):
    c = stability.classify_class_tokens(shop_lists(spark, d))
    return c.select("page_id", big("pre"), big("pos"), "token", "classification")


@query
def sibling_attribute_values(spark, d):
    """Values over the siblings of every element that has the attribute."""
    e = shred.elements(written_lists(spark, d))
    v = stability.sibling_attr_values(e, e.filter(F.array_contains(F.map_keys("attrs"), "data-kind")), "data-kind")
    return v.groupBy("page_id", "value").agg(F.count("*").alias("n"))


@query
def ancestor_chains(spark, d):
    """All ten levels, of every element."""
    e = dom(spark, d)
    a = stability.ancestor_chain(e, shred.elements(e))
    return a.select("page_id", big("pre"), F.transform("ancestors", lambda x: x["tag"]).alias("tags"))


@query
def neighbour_siblings(spark, d):
    a = stability.adjacent_siblings(shred.elements(shop_orders(spark, d)))
    return a.select("page_id", big("pre"), F.col("prev.tag").alias("prev_tag"), F.col("prev.text").alias("prev_text"), F.col("next.tag").alias("next_tag"), F.col("next.class").alias("next_class"))


@query
def element_profiles(spark, d):
    dm = written_lists(spark, d)
    e = shred.elements(dm)
    p = stability.classify_elements(dm, e, e)
    return stability.format_profile(p).select("page_id", big("pre"), "profile")


@query
def element_contexts(spark, d):
    """Surroundings of every element."""
    dm = written_orders(spark, d)
    return stability.dom_context(dm, shred.elements(dm)).select("page_id", big("pre"), "context")


# ---- selectors -----------------------------------------------------------

def with_each(df, names, rows):
    """Every row of ``df`` with each of a few literal rows."""
    lit = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names.split(), row)]) for row in rows])
    return df.select("*", F.inline(lit))


def table(spark, names, rows):
    return spark.createDataFrame(rows, names)


PAGE_SELECTORS = ["//nav//a/@href", "//ul/li[2]/a", ".//article/h1", "/html/body/footer", "//div[@class='ad' or @id='x']", "//nav/ul/*[3]"]


def page_selectors(spark, paths=PAGE_SELECTORS):
    return table(spark, "xpath string", [(p,) for p in paths])


@query
def selectors_parsed(spark, d):
    """Parse one selector per anchor, with the anchor's own address as a literal."""
    a = tokens.anchors(read(spark, d, "pages"))
    x = F.concat(F.lit("//nav/ul/li["), F.col("ord") + 1, F.lit("]/a[@href='"), F.col("href"), F.lit("' and contains(@class,'x')]/@href"))
    p = selectors.parse_selectors(a.withColumn("xpath", x))
    return p.select("page_id", big("ord"), F.size("path.steps").cast("bigint").alias("n_steps"), F.get("path.steps", 2)["pos"].cast("bigint").alias("pos"), "suffix", F.col("error").isNotNull().alias("failed"))


@query
def selector_matches(spark, d):
    m = selectors.match_selectors(dom(spark, d), page_selectors(spark))
    return m.select("page_id", "xpath", big("pre"), "tag", "value")


@query
def selector_matches_without_root(spark, d):
    """Relative and absolute selectors on pages without their html and body tags."""
    bare = F.regexp_replace("html", "</?(html|body)[^>]*>", "")
    dm = shred.shred_html(read(spark, d, "pages").withColumn("html", bare))
    m = selectors.match_selectors(dm, page_selectors(spark, ["//h1", ".//h1", ".//nav//a/@href"]))
    return m.select("page_id", "xpath", "tag", "value")


@query
def selector_unique(spark, d):
    m = selectors.test_unique(dom(spark, d), page_selectors(spark, ["//h1", "//li", "//footer", "//div[@class='ad']", "//h6"]))
    return m.select("page_id", "xpath", big("n"), "is_unique")


def targets_of(dm, condition: str):
    return shred.elements(dm).filter(condition).select(
        "page_id", "pre", F.col("tag").alias("field"), F.lit("text").alias("extract"), F.lit(None).cast("string").alias("attribute_name"), F.lit("").alias("description")
    )


@query
def selectors_generated(spark, d):
    dm = written_orders(spark, d)
    t = targets_of(dm, "tag IN ('h1', 'b', 'i', 'footer') OR cls = 'price'")
    p = stability.classify_elements(dm, shred.elements(dm), t)
    g = induce.generate_selectors(dm, t, p)
    return g.select("page_id", "field", "xpath", F.col("confidence").cast("double").alias("confidence"))


@query
def selectors_by_ancestor(spark, d):
    dm = written_orders(spark, d)
    return induce.ancestor_selectors(dm, targets_of(dm, "tag IN ('h1', 'i', 'p')")).select("page_id", big("pre"), "xpath", "confidence")


@query
def selectors_by_position(spark, d):
    dm = dom(spark, d)
    return induce.positional_selectors(dm, targets_of(dm, "tag <> 'zz'")).select("page_id", big("pre"), "xpath")


@query
def selectors_of_containers(spark, d):
    dm = written_lists(spark, d)
    t = targets_of(dm, "tag IN ('li', 'ul')")
    p = stability.classify_elements(dm, shred.elements(dm), t)
    return induce.container_selectors(dm, t, p).select("page_id", "field", "xpath", big("n"))


@query
def selector_strings(spark, d):
    """Text predicates and extraction suffixes of selectors that quote anchor addresses."""
    a = tokens.anchors(read(spark, d, "pages"))
    q = F.concat(F.lit("'"), "href", F.lit("'"))
    x = (
        F.when(F.col("ord") % 4 == 0, F.concat(F.lit("//a[contains(text(), "), q, F.lit(")]/text()")))
        .when(F.col("ord") % 4 == 1, F.concat(F.lit("//a[@href and text()="), q, F.lit("]/@title")))
        .when(F.col("ord") % 4 == 2, F.concat(F.lit("//a[normalize-space(.)="), q, F.lit(" and @href]")))
        .otherwise(F.concat(F.lit("//a[@href="), q, F.lit("]")))
    )
    s = induce.strip_text_predicates(x)
    return a.select(
        "page_id", big("ord"), s.alias("stripped"), induce.strip_extraction_suffix(s).alias("bare"),
        induce.fix_extraction_suffix(s, F.lit("attribute"), F.lit("href")).alias("as_href"),
        induce.append_extraction(s, F.lit("text"), F.lit(None).cast("string")).alias("as_text"),
    )


def model_targets(dm):
    """Stored answers of varying quality for the title of every order page."""
    k = F.col("page_id") % 3
    return targets_of(dm, "tag = 'h1'").withColumns(
        {
            "xpath": F.when(k == 0, "//h1/text()").when(k == 1, "//div").otherwise("//h2"),
            "fallback_xpath": F.when(k == 1, "//h1[contains(text(),'Order')]").otherwise("//span"),
            "confidence": F.lit(0.9),
            "strategy": F.lit("stored"),
        }
    )


@query
def selectors_validated(spark, d):
    dm = written_orders(spark, d)
    return induce.validate_selectors(dm, model_targets(dm)).select("page_id", "xpath", "valid")


@query
def selectors_chosen(spark, d):
    dm = written_orders(spark, d)
    return induce.choose_selector(dm, model_targets(dm)).select("page_id", "xpath", "fallback_xpath", "confidence")


@query
def selectors_best(spark, d):
    dm = written_orders(spark, d)
    t = model_targets(dm).unionByName(targets_of(dm, "cls = 'price'"), allowMissingColumns=True)
    p = stability.classify_elements(dm, shred.elements(dm), t)
    return induce.select_best(dm, t, p).select("page_id", "field", "xpath", "confidence")


# ---- extraction ----------------------------------------------------------

SELECTOR_DDL = (
    "template_id string, ord int, field string, description string, xpath string, fallback_xpath string, "
    "extract string, attribute_name string, confidence double, sample_value string"
)


def shop_selectors(spark):
    text = lambda t, i, name, x, fb=None: (t, i, name, "", x, fb, "text", None, 0.9, None)
    href = lambda t, i, name, x: (t, i, name, "", x, None, "attribute", "href", 0.8, None)
    return table(spark, SELECTOR_DDL, [
        text("order", 0, "title", "//h1"), text("order", 1, "price", ".//span[contains(@class,'price')]"),
        text("order", 2, "body", "//div[@class='body']//p"), href("order", 3, "prev", "//a[@class='prev']/@href"),
        text("order", 4, "flag", "//b", "//i"), text("order", 5, "content", ".//div[@class='body']/text()"),
        text("list", 0, "name", ".//a"), href("list", 1, "link", "a/@href"), text("list", 2, "cost", ".//span[2]", "span"),
        text("list", 3, "menu", "//div/a"),
    ])


def shop_templates(spark):
    return table(spark, "template_id string, page_type string, container_xpath string, pagination_xpath string",
                 [("order", "detail", None, None), ("list", "list", "//ul/li", None)])


def templated(dm):
    return dm.withColumn("template_id", F.when(F.col("page_id") >= LIST_BASE, "list").otherwise("order"))


@query
def detail_records(spark, d):
    c = extract.compile_templates(shop_selectors(spark))
    r = extract.extract_detail(templated(shop_orders(spark, d)), c)
    return extract.records_wide(r, ["title", "price", "body", "prev", "flag", "content"])


@query
def list_records(spark, d):
    c = extract.compile_templates(shop_selectors(spark), shop_templates(spark))
    r = extract.extract_list(templated(shop_lists(spark, d)), c)
    return extract.records_wide(r, ["name", "link", "cost", "menu"]).withColumn("item", F.col("item").cast("bigint"))


@query
def batch_records(spark, d):
    c = extract.compile_templates(shop_selectors(spark), shop_templates(spark))
    r = extract.extract_pages(templated(shred.shred_html(shop_pages(spark, d))), c)
    return r.groupBy("template_id").agg(F.count("*").alias("n_records"), F.countDistinct("page_id").alias("n_pages"))


@query
def record_fill(spark, d):
    c = extract.compile_templates(shop_selectors(spark))
    return extract.record_fill(extract.extract_detail(templated(shop_orders(spark, d)), c)).select("page_id", "filled", "fields")


@query
def paragraph_text(spark, d):
    """Long text over the real pages: all article paragraphs merged."""
    s = table(spark, SELECTOR_DDL, [("p", 0, "article", "", "//article//p", None, "text", None, 0.5, None)])
    r = extract.extract_detail(dom(spark, d).withColumn("template_id", F.lit("p")), extract.compile_templates(s))
    return r.select("page_id", F.md5(F.try_element_at("data", F.lit("article"))).alias("digest"))


@query
def low_quality_documents(spark, d):
    return read(spark, d, "documents").select("doc_id", tx.is_low_quality(F.col("text")).alias("low"))


@query
def export_heads(spark, d):
    c = extract.compile_templates(shop_selectors(spark), shop_templates(spark))
    r = extract.extract_pages(templated(shred.shred_html(shop_pages(spark, d))), c)
    s = tables.export_summary(r, shop_templates(spark), shop_selectors(spark), "https://shop.example.com/")
    return s.select("template_id", "source_url", "page_type", "total_records", F.size("fields_definition").cast("bigint").alias("n_fields"))


@query
def export_documents(spark, d):
    """One document per archive list: its cards as an ordered page array."""
    s = shop_selectors(spark).filter("template_id = 'list' AND ord < 2")
    c = extract.compile_templates(s, shop_templates(spark))
    r = written(extract.extract_list(templated(shop_lists(spark, d)), c).withColumn("template_id", F.col("page_id").cast("string")))
    ids = r.select("template_id").distinct()
    t = ids.select("template_id", F.lit("list").alias("page_type"))
    f = with_each(
        ids, "ord field description xpath extract confidence",
        [(0, "name", "", ".//a", "text", 0.9), (1, "link", "", "a/@href", "attribute", 0.8)],
    )
    return tables.export_document(r, t, f, "https://shop.example.com/")


# ---- links and patterns --------------------------------------------------

@query
def links_by_selector(spark, d):
    s = page_selectors(spark, ["//ul//a/@href", "//div[contains(@class,'menu')]/a", "//button/@data-url"])
    return links.extract_links(shop_lists(spark, d), s).select("page_id", "xpath", big("pre"), "target")


@query
def page_link_edges(spark, d):
    return links.link_edges(read(spark, d, "pages")).select("page_id", "src", big("ord"), "dst")


@query
def page_links_with_base(spark, d):
    """Links that are relative to a base element."""
    html = F.replace(F.replace(F.col("html"), F.lit('href="/'), F.lit('href="')), F.lit("<head>"), F.lit('<head><base href="/deep/dir/x">'))
    return links.page_links(read(spark, d, "pages").withColumn("html", html)).select("page_id", big("ord"), "target")


def host_urls(spark, d):
    return read(spark, d, "pages").select(u.get_domain(F.col("url")).alias("host"), F.col("page_id").alias("ord"), u.normalize_url(F.col("url")).alias("url"))


@query
def url_schema(spark, d):
    s = links.infer_url_schema(host_urls(spark, d), ["host"])
    return s.select("host", big("pos"), "total", "n_distinct", F.round("entropy", 6).alias("entropy"), "slot")


@query
def url_pattern_counts(spark, d):
    return links.url_patterns(host_urls(spark, d), ["host"])


@query
def segment_kinds(spark, d):
    """Kind of every path segment of pages and links, and of every document word."""
    w = read(spark, d, "documents").select(F.explode(F.split("text", r"\s+")).alias("s"))
    s = w.unionByName(host_urls(spark, d).select(F.explode(u.path_segments(F.col("url"))).alias("s"))).filter("s <> ''")
    kind = links.normalize_segment(F.col("s"))
    return s.groupBy(F.when(kind.startswith("{"), kind).otherwise("literal").alias("kind"), links.is_date_like(F.col("s")).alias("dated"), links.is_token_like(F.col("s")).alias("tokenish")).agg(F.count("*").alias("n"))


@query
def pattern_effects(spark, d):
    p = links.url_patterns(host_urls(spark, d), ["host"])
    return p.select("host", "pattern", links.is_effective_pattern(F.col("pattern"), F.col("n")).alias("effective"))


@query
def pattern_supports(spark, d):
    p = links.pattern_support(links.url_patterns(host_urls(spark, d), ["host"]), ["host"])
    return p.select("host", F.round("coverage", 6).alias("coverage"), F.round("top", 6).alias("top"))


def archive_links(spark, d):
    """Links of three candidate selectors over all archive lists; group = archive chain."""
    paths = [(0, "//a/@href"), (1, "//ul//a/@href"), (2, "//div[contains(@class,'menu')]//a/@href")]
    cands = table(spark, "cand int, xpath string", paths)
    l = links.extract_links(shop_lists(spark, d), cands)
    chain = F.floor((F.col("page_id") - LIST_BASE) / 10)
    l = written(l.select(chain.alias("chain"), "cand", F.struct("page_id", "pre").alias("ord"), "target"))
    return l, with_each(l.select("chain").distinct(), "cand xpath", paths)


@query
def link_scores(spark, d):
    l, c = archive_links(spark, d)
    s = links.score_link_candidates(l, c, 50, ["chain"])
    r = lambda x: F.round(x, 6).alias(x)
    return s.select("chain", big("cand"), "n_urls", r("valid_ratio"), r("coverage"), r("top"), r("score"))


@query
def links_selected(spark, d):
    l, c = archive_links(spark, d)
    return links.select_links(l, links.score_link_candidates(l, c, 50, ["chain"]), 50, ["chain"]).select("chain", big("rank"), "url")


@query
def links_deduped(spark, d):
    l = links.page_links(read(spark, d, "pages")).select((F.col("page_id") * 1000 + F.col("ord")).alias("ord"), F.col("target").alias("url"))
    return links.dedupe_ordered(l)


@query
def domain_buckets(spark, d):
    return links.bucket_by_domain(host_urls(spark, d).select("ord", "url"))


@query
def neighbour_pages(spark, d):
    p = order_pages(spark, d)
    r = extract.extract_detail(templated(shred.shred_html(p)), extract.compile_templates(shop_selectors(spark)))
    h = shop_selectors(spark).filter("attribute_name = 'href'").select("template_id", "ord", "field")
    return links.sub_detail_links(r, p, h, 10).select("page_id", big("rank"), "url")


@query
def path_patterns(spark, d):
    return links.detect_url_pattern(host_urls(spark, d), ["host"])


@query
def urls_under_pattern(spark, d):
    return links.filter_by_pattern(host_urls(spark, d), ["host"])


@query
def crawl_depths(spark, d):
    from webcorpus.operators.graph import crawl_frontier

    p = shop_pages(spark, d)
    seeds = list_pages(spark, d).filter((F.col("page_id") - LIST_BASE) % 10 == 0).select("url")
    return crawl_frontier(links.link_edges(p), seeds, 2, None).select("seed", "url", big("depth"))


@query
def crawl_budget(spark, d):
    from webcorpus.operators.graph import crawl_frontier

    p = shop_pages(spark, d)
    seeds = list_pages(spark, d).filter((F.col("page_id") - LIST_BASE) % 10 == 0).select("url")
    return crawl_frontier(links.link_edges(p), seeds, 3, 15).select("seed", "url", big("depth"), "rank")


@query
def discovered_pages(spark, d):
    """Sitemap of each archive (its orders) joined with a short crawl."""
    from webcorpus.operators.graph import crawl_frontier, discover

    p = shop_pages(spark, d)
    seeds = list_pages(spark, d).filter((F.col("page_id") - LIST_BASE) % 10 == 0).select("page_id", "url")
    o = order_pages(spark, d).select(F.col("page_id").alias("ord"), "url", (LIST_BASE + F.floor(F.col("page_id") / 200) * 10).alias("page_id"))
    maps = o.join(seeds.select("page_id", F.col("url").alias("seed")), "page_id").select("seed", "ord", "url")
    crawled = crawl_frontier(links.link_edges(p), seeds.select("url"), 1, 30).select("seed", "rank", "url")
    return discover(maps, crawled, seeds.select("url"), 100).select("seed", big("rank"), "url")


# ---- pagination ----------------------------------------------------------

def _next(df):
    return df.select("page_id", big("ord"), "target")


@query
def next_links(spark, d):
    return _next(paginate.next_by_link(shop_lists(spark, d)))


@query
def next_clicks(spark, d):
    return _next(paginate.next_by_click(shop_lists(spark, d)))


@query
def next_load_more(spark, d):
    return _next(paginate.next_by_load_more(shop_lists(spark, d)))


@query
def next_params(spark, d):
    return _next(paginate.next_by_param(read(spark, d, "pages")))


@query
def next_pages(spark, d):
    p = list_pages(spark, d)
    return paginate.next_page(paginate.next_candidates(shred.shred_html(p)), p)


def chains(spark, d):
    p = list_pages(spark, d)
    seeds = p.filter((F.col("page_id") - LIST_BASE) % 10 == 0).select("page_id")
    return paginate.follow_pagination(p, paginate.next_candidates(shred.shred_html(p)), seeds, 6, max_target=5)


@query
def pagination_chains(spark, d):
    return chains(spark, d)[0].select("seed", big("n"), "page_id", "url")


@query
def pagination_trace(spark, d):
    t = chains(spark, d)[1]
    return t.select("seed", big("round"), "strategy", big("candidate_count"), "target", "progress", big("total_pages"))


@query
def pagination_stops(spark, d):
    return chains(spark, d)[2].select("seed", big("pages"), "stop_reason")


@query
def first_new_candidate(spark, d):
    """Per page the first anchor target that no earlier page of its block has."""
    l = links.page_links(read(spark, d, "pages")).select("page_id", "ord", "target")
    old = l.filter("ord < 2").select("page_id", "target")
    return paginate.first_unvisited(l, old, ["page_id"]).select("page_id", big("n_candidates"), "target")


@query
def progress_flags(spark, d):
    """Re-fetch series: pages in blocks of five play the visits to one address."""
    s = tokens.page_fingerprint(read(spark, d, "pages")).selectExpr("page_id DIV 5 AS chain", "page_id AS round", "'same' AS url", "fingerprint", "anchor_count")
    return paginate.has_progress(s, ["chain"]).select("chain", "round", "progress")


@query
def pagination_types(spark, d):
    raw = F.element_at(F.array(*[F.lit(x) for x in (" Button", "loadmore", "next-link", "LINK", "load_more", "pages")]), (F.col("page_id") % 6 + 1).cast("int"))
    return read(spark, d, "pages").select("page_id", paginate.parse_pagination_type(raw).alias("kind"))


# ---- health --------------------------------------------------------------

def event_history(spark, d):
    return read(spark, d, "events").select(
        F.col("event_type").alias("template_id"), F.concat(F.lit("f"), F.col("user_id") % 3).alias("field"),
        F.col("event_id").alias("seq"), F.when(F.col("value") > 12, F.col("event_id").cast("string")).alias("value"),
    )


@query
def observations(spark, d):
    s = table(spark, SELECTOR_DDL, [("nav", i, n, "", f"//nav/ul/li[{i}]/a", None, "text", None, 0.5, None) for i, n in ((4, "fourth"), (5, "fifth"), (6, "sixth"))])
    r = extract.extract_detail(dom(spark, d).withColumn("template_id", F.lit("nav")), extract.compile_templates(s))
    return health.field_history(r.withColumn("seq", F.col("page_id")), s)


@query
def health_windows(spark, d):
    return health.health_window(event_history(spark, d))


@query
def healing_flags(spark, d):
    return health.needs_healing(event_history(spark, d)).select("template_id", "field", "seq", "value", "flagged")


@query
def healing_flags_pages(spark, d):
    return health.needs_healing(observations_of(spark, d)).select("template_id", "field", "seq", "flagged")


def observations_of(spark, d):
    return observations(spark, d)


@query
def cascade_flags(spark, d):
    f = health.needs_healing(event_history(spark, d)).withColumn("seq", F.floor(F.col("pos") / 1))
    c = health.cascade_failure(f)
    return c.select("template_id", big("seq"), F.round("failing", 6).alias("failing"), "cascade")


@query
def attempts_after_repair(spark, d):
    """Attempt counters per (event type, user) after the last event of each pair was tried."""
    e = read(spark, d, "events")
    a = e.groupBy(F.col("event_type").alias("template_id"), F.col("user_id").cast("string").alias("field")).agg(F.count("*").cast("int").alias("attempts"), F.max("event_id").alias("last"))
    o = a.filter("last % 3 <> 0").select("template_id", "field", (F.col("last") % 3 == 1).alias("healed"))
    r = health.can_heal(health.record_attempts(a.select("template_id", "field", "attempts"), o))
    return r.select("template_id", "field", big("attempts"), "can_heal")


@query
def history_after_reset(spark, d):
    h = event_history(spark, d)
    return health.needs_healing(health.after_reset(h, h.filter("seq % 97 = 0").select("template_id", "field", "seq"))).select("template_id", "field", "seq", "flagged")


@query
def similar_names(spark, d):
    p = read(spark, d, "part")
    return p.select("p_partkey", tx.is_similar(F.col("p_name"), F.lower("p_type")).alias("a"), tx.is_similar(F.col("p_brand"), F.concat(F.lit("Brand"), F.col("p_size"))).alias("b"))


def samples():
    k, price = F.col("p_partkey"), F.col("p_retailprice")
    cents = F.format_string("%d.50", price.cast("bigint"))
    return (
        F.when(k % 5 == 0, F.concat(F.lit("$ "), cents)).when(k % 5 == 1, cents)
        .when(k % 5 == 2, F.concat(F.lit("/part/"), k)).when(k % 5 == 3, F.concat(F.lit("a@b"), k, F.lit(".com")))
        .otherwise(F.col("p_name"))
    )


@query
def value_shapes(spark, d):
    return read(spark, d, "part").select("p_partkey", tx.infer_pattern(samples()).alias("shape"))


@query
def healed_values(spark, d):
    old = F.when(F.col("p_partkey") % 2 == 0, "$ 12").when(F.col("p_partkey") % 3 == 0, "/x").otherwise("")
    return read(spark, d, "part").select("p_partkey", health.validate_healed(samples(), old).alias("ok"))


# ---- repair --------------------------------------------------------------

def broken(spark, d):
    """Selectors whose class was renamed on the site."""
    rows = [
        ("price", ".//span[contains(@class,'prices')]/text()", "text", None, "$ 10"),
        ("prev", "//a[contains(@class,'prew')]/@href", "attribute", "href", None),
        ("cost", ".//span[contains(@class,'zzzzzzzzzz')]", "text", None, "$ 7"),
    ]
    return with_each(
        read(spark, d, "orders").select(F.col("o_orderkey").alias("page_id")), "field xpath extract attribute_name sample_value", rows
    )


@query
def repaired_by_class(spark, d):
    return heal.recover_by_class(shop_orders(spark, d), broken(spark, d)).select("page_id", "field", "new_xpath")


@query
def repaired_by_pattern(spark, d):
    return heal.recover_by_pattern(shop_orders(spark, d), broken(spark, d)).select("page_id", "field", "new_xpath")


@query
def fields_healed(spark, d):
    """Code recovery, else the element that a stored answer points at."""
    dm = written_orders(spark, d)
    lost = read(spark, d, "orders").select(F.col("o_orderkey").alias("page_id"), F.lit("lost").alias("field"), F.lit("//h9").alias("xpath"), F.lit("text").alias("extract"))
    b = broken(spark, d).unionByName(lost, allowMissingColumns=True)
    found = shred.elements(dm).filter("tag = 'h1'").select("page_id", F.lit("lost").alias("field"), "pre")
    p = stability.classify_elements(dm, shred.elements(dm), found)
    return heal.heal_fields(dm, b, found, p).select("page_id", "field", "new_xpath", "new_confidence")


@query
def records_after_repair(spark, d):
    """Pages from order 100 on are extracted again once the price selector is repaired."""
    dm = templated(shop_orders(spark, d)).withColumn("seq", F.col("page_id"))
    r = table(
        spark, "template_id string, field string, new_xpath string, new_fallback string, new_confidence double, new_source string",
        [("order", "price", "//h1", None, 0.7, "code")],
    )
    since = table(spark, "template_id string, from_seq long", [("order", 100)])
    out = heal.reextract_changed(dm, shop_selectors(spark), shop_templates(spark), r, since)
    return out.select("page_id", F.try_element_at("data", F.lit("price")).alias("price"))


@query
def container_works(spark, d):
    c = table(spark, "container_xpath string", [("//ul/li",), ("//ol/li",)])
    return heal.container_health(shred.shred_html(shop_pages(spark, d)), c)


# ---- stored answers ------------------------------------------------------

def answers(spark, d):
    """Answers for every order page; the shapes vary with the order key."""
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("page_id"), (F.col("o_orderkey") % 4).alias("k"))
    q = lambda s: F.lit(s)
    typ = F.when(F.col("k") == 3, "article").when(F.col("k") == 0, "list").otherwise("detail")
    conf = lambda a: F.when(F.col("page_id") % 5 < 2, F.lit(0.5 + a / 10)).otherwise(F.lit(0.9))
    json = lambda a: F.concat(q('{"page_type": "'), typ, q('", "confidence": '), conf(a).cast("string"), q(', "reason": "r"}'))
    fenced = lambda c: F.when(F.col("page_id") % 2 == 0, F.concat(q("```json\n"), c, q("\n```"))).otherwise(c)
    one = lambda kind, attempt, content: o.select("page_id", q(kind).alias("prompt_kind"), F.lit(attempt).alias("attempt"), content.alias("content"))
    lists = F.concat(
        q('{"page_type": "list", "container_aid": "e'), F.col("page_id") % 40, q('", "primary_detail_link_xpath": '),
        F.when(F.col("k") == 0, q('"//a[@data-aid]"')).otherwise(q('" //main//a/@href "')),
        q(', "detail_link_xpath_candidates": [{"xpath": "//ul//a/@href", "confidence": 0.6}, {"xpath": "//main//a/@href"}, {"xpath": " "}], "pagination": {"next_aid": "e5", "type": "Button"}}'),
    )
    fields = F.concat(
        q('{"fields": [{"name": "title", "aid": "e9", "extract": "text", "description": "t"}, {"name": "far", "aid": "e'),
        F.col("page_id") % 60, q('", "extract": "attribute", "attribute_name": "href", "description": "f"}, {"name": "bad", "aid": "e1", "extract": "html", "description": "x"}]'),
    )
    detail = F.concat(fields, q("}"))
    legacy = F.concat(fields, q(', "page_type": "'), F.when(F.col("k") == 1, "list").otherwise("detail"), q('"}'))
    heal_json = F.concat(q('{"found": '), F.when(F.col("k") == 2, "false").otherwise("true"), q(', "aid": "e9"}'))
    return (
        one("page_type", 0, fenced(json(0))).unionByName(one("page_type", 1, json(1)))
        .unionByName(one("list_fields", 0, fenced(lists))).unionByName(one("detail_fields", 0, fenced(detail)))
        .unionByName(one("legacy", 0, legacy)).unionByName(one("heal", 0, fenced(heal_json)))
    )


def order_elements(spark, d):
    return shred.elements(shop_orders(spark, d)).select("page_id", "aid")


@query
def prompts_built(spark, d):
    p = responses.build_prompts(clean.render_html(shop_orders(spark, d)), "page_type")
    return p.select("page_id", "prompt_kind", F.md5(F.regexp_extract("prompt", r"(?s)---\n(.*)$", 1)).alias("digest"))


@query
def fences_stripped(spark, d):
    a = answers(spark, d)
    return a.select("page_id", "prompt_kind", big("attempt"), responses.strip_fences(F.col("content")).alias("content"))


@query
def page_types_parsed(spark, d):
    return responses.parse_page_type(answers(spark, d)).select("page_id", big("attempt"), "page_type", "confidence")


@query
def detections_picked(spark, d):
    return responses.pick_detection(responses.parse_page_type(answers(spark, d))).select("page_id", "page_type", "confidence", "use_legacy")


@query
def list_headers(spark, d):
    h, _ = responses.parse_list_response(answers(spark, d), order_elements(spark, d))
    return h.select("page_id", "page_type", "container_aid", "primary", F.col("pagination.next_aid").alias("next_aid"), F.col("pagination.type").alias("next_type"))


@query
def list_candidates(spark, d):
    _, c = responses.parse_list_response(answers(spark, d), order_elements(spark, d))
    return c.select("page_id", big("ord"), "xpath", "confidence")


@query
def fields_parsed(spark, d):
    return responses.parse_fields(answers(spark, d), order_elements(spark, d)).select("page_id", big("ord"), "field", "aid", "extract", "attribute_name")


@query
def legacy_converted(spark, d):
    t, c, f = responses.legacy_to_v2(answers(spark, d), written(order_elements(spark, d)))
    n = lambda df, name: df.groupBy("page_id").agg(F.count("*").alias(name))
    return t.join(n(c, "n_candidates"), "page_id", "left").join(n(f, "n_fields"), "page_id", "left").select("page_id", "page_type", F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"), F.coalesce("n_fields", F.lit(0)).alias("n_fields"))


@query
def heal_answers(spark, d):
    return responses.parse_heal_response(answers(spark, d))


# ---- jobs ----------------------------------------------------------------

@query
def pages_routed(spark, d):
    """Routes from all answers."""
    a, e = answers(spark, d), order_elements(spark, d)
    t = responses.pick_detection(responses.parse_page_type(a))
    _, c = responses.parse_list_response(a, e)
    return jobs.route_pages(t, c, responses.parse_fields(a, e))


def shop_analysis(spark, d):
    """Analysis of every archive's first order page: two fields per template."""
    p = order_pages(spark, d).filter("page_id % 200 = 0")
    dm = written(shred.shred_html(p))
    det = p.select("page_id", F.lit("detail").alias("page_type"))
    f = shred.elements(dm).filter("tag = 'h1' OR cls = 'price'").select(
        "page_id", F.when(F.col("tag") == "h1", 0).otherwise(1).alias("ord"), F.when(F.col("tag") == "h1", "title").otherwise("price").alias("field"),
        "aid", F.lit("text").alias("extract"), F.lit(None).cast("string").alias("attribute_name"), F.lit("").alias("description"),
    )
    return jobs.build_templates(dm, det, f)


@query
def templates_built(spark, d):
    t, s = shop_analysis(spark, d)
    return s.select("template_id", "field", "xpath", "confidence")


def archive_job(spark, d):
    p = shop_pages(spark, d)
    dm = written(shred.shred_html(p))
    seeds = list_pages(spark, d).filter((F.col("page_id") - LIST_BASE) % 10 == 0).select("page_id")
    c = with_each(
        seeds.select(F.col("page_id").alias("seed")), "cand xpath",
        [(0, "//div[contains(@class,'menu')]//a/@href"), (1, "//ul//a/@href")],
    )
    t, s = shop_analysis(spark, d)
    return jobs.list_job(p, dm, seeds, c, t, s, max_pages=1000, max_list_pages=10)


@query
def archive_records(spark, d):
    r, _ = archive_job(spark, d)
    return r.select("seed", "host", "page_id", F.try_element_at("data", F.lit("title")).alias("title"), F.try_element_at("data", F.lit("price")).alias("price"))


@query
def archive_export_host(spark, d):
    r, b = archive_job(spark, d)
    return jobs.pick_export_template(r, b)


@query
def detail_trail(spark, d):
    """Trails from every order page."""
    p = order_pages(spark, d)
    starts = p.select("page_id", F.lit("order").alias("template_id"))
    s = shop_selectors(spark).filter("template_id = 'order'")
    r = jobs.detail_job(p, written_orders(spark, d), starts, s)
    return r.select("page_id", "source", F.try_element_at("data", F.lit("title")).alias("title"))


@query
def templates_reanalysed(spark, d):
    """Templates in cascade failure: every third archive, re-analysed with mixed success."""
    t, s = shop_analysis(spark, d)
    t, n = t.drop("page_id"), F.col("template_id").cast("bigint") / 200
    new_t = t.withColumn("page_type", F.when(n % 2 == 0, "detail").otherwise("list"))
    new_s = s.withColumn("xpath", F.lit("//h1"))
    _, out, once = jobs.reanalyze_on_cascade(t.filter(n % 3 == 0).select("template_id"), t, s, new_t, new_s)
    return out.groupBy("template_id", (F.col("xpath") == "//h1").alias("replaced")).agg(F.count("*").alias("n"))
