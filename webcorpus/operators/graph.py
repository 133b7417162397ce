"""Breadth-first discovery over the link graph, all seeds at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from webcorpus.functions.urls import get_domain, normalize_url, url_path
from webcorpus.operators.links import detect_url_pattern, filter_by_pattern
from webcorpus.session import cut_lineage

def parse_sitemaps(sitemaps: DataFrame) -> DataFrame:
    """(site, ord, url) from sitemaps(site, base_url, xml), read by Spark's XML reader.

    Index files and documents that are not well-formed give no rows; CDATA,
    references, comments and namespaces mean what XML says.
    """
    schema = "url array<struct<loc: string>>, bad string"
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad", "ignoreNamespace": "true"}
    return (
        sitemaps.filter("xml IS NOT NULL")
        .withColumn("_x", F.from_xml("xml", schema, options))
        .filter("_x.bad IS NULL")
        .select("site", "base_url", F.posexplode("_x.url").alias("ord", "entry"))
        .withColumn("url", normalize_url(F.trim("entry.loc"), F.col("base_url")))
        .filter(F.col("url").isNotNull())
        .select("site", "ord", "url")
    )


def filter_sitemap_scope(urls: DataFrame, start_url: Column | str) -> DataFrame:
    """URLs whose path starts with the start path without its last slash."""
    start = F.lit(start_url) if isinstance(start_url, str) else start_url
    return urls.filter(url_path(F.col("url")).startswith(F.regexp_replace(url_path(start), "/+$", "")))


def crawl_frontier(edges: DataFrame, seeds: DataFrame, max_depth: int = 3, max_pages: int | None = 200) -> DataFrame:
    """(seed, url, depth, rank): pages reachable from each seed, in breadth-first order.

    ``edges``: src, ord, dst; ``seeds``: url. A level is one join of the whole
    frontier with the edges and one anti join with what was seen. ``max_pages``
    bounds the pages per seed as the crawl budget does; None removes the bound.
    """
    # a page leaves its site only if the edge table does, so the host test is per edge;
    # every level reads the edges again, so they are written once
    hops = cut_lineage(
        edges.filter(get_domain(F.col("src")) == get_domain(F.col("dst"))).select("src", "ord", "dst")
    )
    seen = cut_lineage(
        seeds.select(F.col("url").alias("seed"), "url", F.lit(0).alias("depth"), F.lit(1).cast("bigint").alias("rank")).distinct()
    )
    frontier = seen
    for depth in range(1, max_depth + 1):
        found = (
            frontier.join(hops, frontier["url"] == hops["src"])
            .groupBy("seed", F.col("dst").alias("url"))
            .agg(F.min(F.struct("rank", "ord")).alias("via"))
            .join(seen.select("seed", "url"), ["seed", "url"], "left_anti")
        )
        if max_pages is None:
            level = found.select("seed", "url", F.lit(depth).alias("depth"), F.lit(None).cast("bigint").alias("rank"))
        else:
            used = seen.groupBy("seed").agg(F.count("*").alias("used"))
            order = W.partitionBy("seed").orderBy("via", "url")
            level = (
                found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= max_pages)
                .join(used, "seed").filter(F.col("place") + F.col("used") <= max_pages)
                .select("seed", "url", F.lit(depth).alias("depth"), (F.col("place") + F.col("used")).alias("rank"))
            )
        frontier = cut_lineage(level)
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def discover(sitemap_urls: DataFrame, crawled: DataFrame, seeds: DataFrame, max_pages: int = 100) -> DataFrame:
    """(seed, rank, url): sitemap then crawled URLs, reduced to the common path pattern.

    ``sitemap_urls``: seed, ord, url; ``crawled``: seed, rank, url. The start
    page is always present, first when the pattern had dropped it.
    """
    both = sitemap_urls.select("seed", "url", F.struct(F.lit(0).alias("source"), F.col("ord").cast("bigint").alias("ord")).alias("o")).unionByName(
        crawled.select("seed", "url", F.struct(F.lit(1).alias("source"), F.col("rank").cast("bigint").alias("ord")).alias("o"))
    )
    merged = both.groupBy("seed", "url").agg(F.min("o").alias("o"))
    ordered = merged.select("seed", "url", (F.col("o.source").cast("bigint") * (1 << 40) + F.col("o.ord")).alias("ord"))
    kept = filter_by_pattern(ordered, ["seed"], detect_url_pattern(ordered, ["seed"]))
    start = seeds.select(F.col("url").alias("seed"), "url", F.lit(-1).cast("bigint").alias("ord")).join(
        kept.select("seed", "url"), ["seed", "url"], "left_anti"
    )
    w = W.partitionBy("seed").orderBy("ord", "url")
    return (
        kept.unionByName(start).withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= max_pages).select("seed", "rank", "url")
    )
