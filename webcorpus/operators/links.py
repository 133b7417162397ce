"""Links and URL-pattern learning.

Pattern statistics are two-level aggregations: counts per distinct value first
(partial aggregation shrinks hot hosts before the shuffle), then one row per
group and path position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from webcorpus.functions.urls import (
    get_domain, is_basic_valid, link_url, normalize_url, parent_path, path_segments, url_part, AUTHORITY,
)
from webcorpus.operators.selectors import match_selectors
from webcorpus.operators.shred import dom_base
from webcorpus.operators.tokens import anchors
from webcorpus.session import join_small

# Fixed values.
NAV_WORDS = ("about", "contact", "privacy", "terms", "category", "tag", "help", "login", "signup")
DETAIL_WORDS = ("article", "detail", "post", "/p/", "\\{id\\}")
W_VALID, W_COVERAGE, W_TOP, W_VOLUME = 0.30, 0.40, 0.15, 0.15
RUNNER_UP_GAP = 0.1
TIE = 1e-9


# ---- links ---------------------------------------------------------------

def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, url, ord, target): all anchors as canonical URLs, duplicates kept. Flat, no tree."""
    return (
        anchors(pages)
        .withColumn("target", link_url(F.col("href"), F.col("base")))
        .filter(F.col("target").isNotNull())
        .select("page_id", "url", "ord", "target")
    )


def extract_links(dom: DataFrame, selectors: DataFrame, template: str | None = None) -> DataFrame:
    """(page_id, url, selector columns..., pre, target) for links under a selector.

    Elements give their ``href``; attribute results are used as they are.
    """
    plain = ~F.col("xpath").rlike(r"/(?:text\(\)|@[\w:\-]+)$")
    asked = selectors.withColumns(
        {"_given": F.col("xpath"), "xpath": F.when(plain, F.concat("xpath", F.lit("/@href"))).otherwise(F.col("xpath"))}
    )
    keep = [c for c in selectors.columns if c not in (template, "xpath")]
    extra = [template] if template else []
    # only link attributes were made absolute; other values are plain references
    is_link = F.col("xpath").rlike(r"/@(?:href|src|action)$")
    target = F.when(is_link, link_url(F.col("value"), F.col("_base"))).otherwise(normalize_url(F.col("value"), F.col("_base")))
    return (
        match_selectors(dom.withColumn("_base", dom_base()), asked, template, ["_base"])
        .withColumn("target", target)
        .filter("value IS NOT NULL AND target IS NOT NULL")
        .select("page_id", "url", *extra, *keep, F.col("_given").alias("xpath"), "pre", "target")
    )


def link_edges(pages: DataFrame) -> DataFrame:
    """(page_id, src, ord, dst): links that stay on the page's authority."""
    return (
        page_links(pages)
        .filter(get_domain(F.col("target")) == get_domain(F.col("url")))
        .select("page_id", F.col("url").alias("src"), "ord", F.col("target").alias("dst"))
    )


# ---- patterns ------------------------------------------------------------

def is_date_like(s: Column) -> Column:
    return s.rlike(r"(?U)^(?:\d{4}-\d{1,2}-\d{1,2}|\d{8}|\d{4})$")


def is_token_like(s: Column) -> Column:
    return F.lower(s).rlike(r"^(?:[0-9a-f]{8,}|[0-9a-f-]{18,})$") | s.rlike(r"^[a-zA-Z0-9_-]{20,}$")


def is_digits(s: Column) -> Column:
    return s.rlike(r"(?U)^\d+$")


def normalize_segment(s: Column) -> Column:
    return (
        F.when(is_digits(s), "{id}")
        .when(is_date_like(s), "{date}")
        .when(is_token_like(s), "{token}")
        .when(F.length(s) > 30, "{var}")
        .otherwise(F.lower(s))
    )


def segment_counts(urls: DataFrame, group: list[str]) -> DataFrame:
    """(group, pos, segment, n, first): how often each segment occurs at each position."""
    return (
        urls.select(*group, "ord", F.posexplode(path_segments(F.col("url"))).alias("pos", "segment"))
        .groupBy(*group, "pos", "segment")
        .agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    )


def infer_url_schema(urls: DataFrame, group: list[str]) -> DataFrame:
    """(group, pos, total, n_distinct, entropy, slot) from urls(group, ord, url)."""
    s, n = F.col("segment"), F.col("n")
    share = lambda cond: F.sum(F.when(cond, n).otherwise(0)) / F.sum(n)
    # sum(-p log2 p) = log2(N) - sum(n log2 n) / N
    stats = segment_counts(urls, group).groupBy(*group, "pos").agg(
        F.sum(n).alias("total"),
        F.count("*").alias("n_distinct"),
        (F.log2(F.sum(n)) - F.sum(n * F.log2(n)) / F.sum(n)).alias("entropy"),
        share(is_digits(s)).alias("r_digits"),
        share(is_date_like(s)).alias("r_date"),
        share(is_token_like(s)).alias("r_token"),
        F.min_by(s, F.struct((-n).alias("k"), "first")).alias("mode"),
    )
    slot = (
        F.when(F.col("r_digits") >= 0.6, "{id}")
        .when(F.col("r_date") >= 0.5, "{date}")
        .when(F.col("r_token") >= 0.5, "{token}")
        .when((F.col("n_distinct") / F.col("total") > 0.6) | (F.col("entropy") > 1.2), "{var}")
        .otherwise(F.lower("mode"))
    )
    return stats.select(*group, "pos", "total", "n_distinct", "entropy", slot.alias("slot"))


def build_pattern(url: Column, slots: Column) -> Column:
    seg = F.transform(
        path_segments(url),
        lambda s, i: F.when(F.coalesce(F.get(slots, i), F.lit("{var}")).startswith("{"), normalize_segment(s)).otherwise(F.lower(s)),
    )
    return F.concat(get_domain(url), F.lit("/"), F.array_join(seg, "/"))


def schema_arrays(schema: DataFrame, group: list[str]) -> DataFrame:
    """One row per group: ``slots`` in path order. Paths are short, so are the arrays."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "slot")))
    return schema.groupBy(*group).agg(F.transform(ordered, lambda x: x["slot"]).alias("slots"))


def url_patterns(urls: DataFrame, group: list[str], schema: DataFrame | None = None, spread: str = "url") -> DataFrame:
    """(group, pattern, n)."""
    schema = infer_url_schema(urls, group) if schema is None else schema
    # groups without any path segment have no schema row: left join
    joined = join_small(urls, schema_arrays(schema, group), group, spread, how="left")
    return joined.groupBy(*group, build_pattern(F.col("url"), F.col("slots")).alias("pattern")).agg(F.count("*").alias("n"))


def is_effective_pattern(pattern: Column, n: Column) -> Column:
    p = F.lower(pattern)
    return ~p.rlike("|".join(NAV_WORDS)) & ((n >= 3) | ((n >= 2) & p.rlike("|".join(DETAIL_WORDS))))


def pattern_support(patterns: DataFrame, group: list[str]) -> DataFrame:
    """(group, coverage, top): share covered by effective patterns, share of the top pattern."""
    n = F.col("n")
    good = F.when(is_effective_pattern(F.col("pattern"), n), n).otherwise(0)
    return patterns.groupBy(*group).agg(
        (F.sum(good) / F.sum(n)).alias("coverage"), (F.max(n) / F.sum(n)).alias("top")
    )


# ---- candidate scoring ---------------------------------------------------

def score_link_candidates(links: DataFrame, candidates: DataFrame, max_pages: int, group: list[str] | None = None) -> DataFrame:
    """Score link selectors by the URL patterns of what they select.

    ``links``: group..., cand (order of the candidate), ord (any orderable), target.
    ``candidates``: group..., cand, xpath; candidates without links score as well.
    """
    key = [*(group or []), "cand"]
    counts = links.groupBy(*key, F.col("target").alias("url")).agg(F.count("*").alias("copies"), F.min("ord").alias("ord"))
    totals = counts.groupBy(*key).agg(
        F.sum("copies").alias("matches"), F.sum(is_basic_valid(F.col("url")).cast("bigint")).alias("n_urls")
    )
    valid = counts.filter(is_basic_valid(F.col("url"))).select(*key, "ord", "url")
    support = pattern_support(url_patterns(valid, key), key)
    out = candidates.join(totals, key, "left").join(support, key, "left")
    ratio = F.coalesce(F.col("n_urls"), F.lit(0)) / F.greatest(F.coalesce(F.col("matches"), F.lit(0)), F.lit(1))
    volume = F.least(F.lit(1.0), F.coalesce(F.col("n_urls"), F.lit(0)) / F.lit(max(1, max_pages)))
    coverage, top = F.coalesce("coverage", F.lit(0.0)), F.coalesce("top", F.lit(0.0))
    return out.select(
        *key, "xpath", F.coalesce("n_urls", F.lit(0)).alias("n_urls"), ratio.alias("valid_ratio"),
        coverage.alias("coverage"), top.alias("top"),
        (ratio * W_VALID + coverage * W_COVERAGE + top * W_TOP + volume * W_VOLUME).alias("score"),
    )


def dedupe_ordered(urls: DataFrame, group: list[str] | None = None, url: str = "url", order: str = "ord") -> DataFrame:
    """First occurrence of every URL."""
    return urls.groupBy(*(group or []), url).agg(F.min(order).alias(order))


def select_links(links: DataFrame, scores: DataFrame, max_pages: int, group: list[str] | None = None) -> DataFrame:
    """(group, rank, url): links of the best candidate, joined by a close runner-up.

    Only the first ``max_pages`` per group are asked for; window group limits
    keep no more than that per task.
    """
    group = group or []
    part = W.partitionBy(*(group or [F.lit(1)]))
    ranked = scores.withColumn("place", F.row_number().over(part.orderBy(F.desc(F.round("score", 9)), "cand"))).filter("place <= 2")
    best = ranked.withColumn("best", F.max("score").over(part)).filter(
        (F.col("place") == 1) | (F.col("best") - F.col("score") <= RUNNER_UP_GAP + TIE)
    )
    chosen = join_small(links, best.select(*group, "cand", "place"), [*group, "cand"], "target")
    urls = (
        chosen.filter(is_basic_valid(F.col("target")))
        .groupBy(*group, F.col("target").alias("url")).agg(F.min(F.struct("place", "ord")).alias("o"))
    )
    return (
        urls.withColumn("rank", F.row_number().over(part.orderBy("o.place", "o.ord", "url")))
        .filter(F.col("rank") <= max_pages).select(*group, "rank", "url")
    )


def host_of(url: Column) -> Column:
    return F.coalesce(F.nullif(get_domain(url), F.lit("")), F.lit("unknown"))


def bucket_by_domain(urls: DataFrame, group: list[str] | None = None) -> DataFrame:
    """(group, host, n, bucket_ord, template_url) from urls(ord, url): hosts by first appearance."""
    first = F.min(F.struct("ord", "url"))
    hosts = urls.groupBy(*(group or []), host_of(F.col("url")).alias("host")).agg(
        F.count("*").alias("n"), first.alias("first")
    )
    return hosts.select(
        *(group or []), "host", "n", F.col("first.ord").alias("bucket_ord"), F.col("first.url").alias("template_url")
    )


# ---- neighbours and path patterns ---------------------------------------

def sub_detail_links(records: DataFrame, pages: DataFrame, href_fields: DataFrame, max_pages: int) -> DataFrame:
    """(page_id, rank, url): where to go next from a detail page.

    Values of href fields come first, then anchors with the same authority and
    the same parent path. ``records``: page_id, url, template_id, data;
    ``href_fields``: template_id, ord, field.
    """
    named = join_small(records, href_fields, ["template_id"], "page_id")
    from_fields = named.select(
        "page_id", "url", F.lit(0).alias("source"), F.col("ord").alias("ord"),
        normalize_url(F.try_element_at("data", F.col("field")), F.col("url")).alias("target"),
    )
    near = page_links(pages).filter(
        (url_part(F.col("target"), AUTHORITY) == url_part(F.col("url"), AUTHORITY))
        & (parent_path(F.col("target")) == parent_path(F.col("url")))
        & (F.col("target") != F.col("url"))
    )
    from_page = near.select("page_id", "url", F.lit(1).alias("source"), "ord", "target")
    both = from_fields.filter("target IS NOT NULL").unionByName(from_page)
    first = both.groupBy("page_id", "target").agg(F.min(F.struct("source", "ord")).alias("o"))
    w = W.partitionBy("page_id").orderBy("o", "target")
    return first.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= max_pages).select(
        "page_id", "rank", F.col("target").alias("url")
    )


def first_segment(url: Column) -> Column:
    path = F.regexp_replace(F.regexp_extract(url, r"^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)", 1), r"^/+|/+$", "")
    return F.when(path != "", F.element_at(F.split(path, "/", -1), 1))


def detect_url_pattern(urls: DataFrame, group: list[str]) -> DataFrame:
    """(group, total, pattern): ``/seg/*`` when one first segment holds at least 30%."""
    seg = urls.groupBy(*group, first_segment(F.col("url")).alias("seg")).agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    top = seg.groupBy(*group).agg(
        F.sum("n").alias("total"),
        F.min(F.when(F.col("seg").isNotNull(), F.struct((-F.col("n")).alias("k"), "first", "seg"))).alias("top"),
    )
    ok = (F.col("total") >= 3) & (-F.col("top.k") >= F.col("total") * 0.3)
    return top.select(*group, "total", F.when(ok, F.concat(F.lit("/"), F.col("top.seg"), F.lit("/*"))).alias("pattern"))


def filter_by_pattern(urls: DataFrame, group: list[str], patterns: DataFrame | None = None) -> DataFrame:
    """URLs under the group's pattern; all of them when fewer than 30% would stay."""
    patterns = detect_url_pattern(urls, group) if patterns is None else patterns
    path = F.regexp_extract(F.col("url"), r"^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)", 1)
    prefix = F.regexp_replace("pattern", r"\*$", "")
    under = F.coalesce(path.startswith(prefix) | (path == F.regexp_replace(prefix, "/$", "")), F.lit(True))
    marked = join_small(urls, patterns.select(*group, "pattern"), group, "url", how="left").withColumn("under", under)
    shares = marked.groupBy(*group).agg((F.avg(F.col("under").cast("double")) >= 0.3).alias("strict"))
    out = join_small(marked, shares, group, "url", how="left")
    return out.filter(F.col("under") | ~F.col("strict")).select(*urls.columns)
