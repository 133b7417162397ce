"""Pagination over a fetched corpus: next-page candidates and chains of list pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from webcorpus.functions.text import let
from webcorpus.functions.urls import increment_page_param, link_url, normalize_url
from webcorpus.operators.selectors import match, parse_path, split_suffix, values_of
from webcorpus.operators.shred import dom_base
from webcorpus.session import cut_lineage

# Fixed values.
NEXT_WORD, MORE_WORD = "下一页", "加载更多"
STRATEGIES = ("link", "click", "load_more", "infinite_scroll")
TYPE_ALIASES = {
    "button": "load_more", "loadmore": "load_more", "next_button": "load_more",
    "next-link": "link", "next_link": "link",
}
LINK_XPATH = f"//a[contains(@class,'next') or contains(normalize-space(text()),'{NEXT_WORD}')]/@href"
CLICK_XPATHS = (
    f"//a[contains(normalize-space(text()),'{NEXT_WORD}')]/@href",
    "//a[contains(@class,'next')]/@href",
    f"//button[contains(normalize-space(text()),'{NEXT_WORD}')]/@data-url",
    "//button[contains(@class,'next')]/@data-url",
)
MORE_XPATHS = (
    f"//a[contains(normalize-space(text()),'{MORE_WORD}')]/@href",
    f"//button[contains(normalize-space(text()),'{MORE_WORD}')]/@data-url",
    "//a[contains(@class,'load_more')]/@href",
    "//button[contains(@class,'load_more')]/@data-url",
)


def parse_pagination_type(raw: Column) -> Column:
    """link, load_more or infinite_scroll after alias lookup; null when unknown."""
    t = F.lower(F.trim(raw.cast("string")))
    table = F.create_map(*[F.lit(x) for kv in TYPE_ALIASES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, t), F.when(t.isin("link", "load_more", "infinite_scroll"), t))


def _raw_values(xpath: Column) -> Column:
    path, suffix = split_suffix(xpath)
    found = match(parse_path(path), F.col("nodes"), F.col("texts"))
    return values_of(found, suffix, F.col("text"), F.col("nodes"), F.col("texts"))


def _targets(xpath: str | Column) -> Column:
    """Array of canonical targets of a selector; unusable ones are null."""
    column = F.lit(xpath) if isinstance(xpath, str) else xpath
    is_link = column.endswith("/@href")
    made = lambda base: F.transform(
        _raw_values(column), lambda v: F.when(is_link, link_url(v, base)).otherwise(normalize_url(v, base))
    )
    return let(dom_base(), made)


def _rows(dom: DataFrame, strategy: str, targets: Column) -> DataFrame:
    return dom.select("page_id", "url", F.lit(strategy).alias("strategy"), F.posexplode(targets).alias("ord", "target")).filter(
        F.col("target").isNotNull()
    )


def _targets_of_all(xpaths: tuple[str, ...]) -> Column:
    return F.flatten(F.transform(F.array(*[F.lit(x) for x in xpaths]), _targets))


def link_targets(selector: Column | None) -> Column:
    """Targets of the given selector; the built-in one is used only if that finds nothing at all."""
    builtin = _targets(LINK_XPATH)
    if selector is None:
        return builtin
    asked = F.when(selector.endswith("/@href"), selector).otherwise(F.concat(F.element_at(F.split(selector, r"/text\(\)"), 1), F.lit("/@href")))
    # elements without href count as found: they give null targets
    path, _ = split_suffix(asked)
    found = F.size(match(parse_path(path), F.col("nodes"), F.col("texts")))
    own = _targets(asked)
    hit = F.when(selector.endswith("/@href"), F.size(own) > 0).otherwise(found > 0)
    return F.when(F.coalesce(hit, F.lit(False)), own).otherwise(builtin)


def next_by_link(dom: DataFrame, selector: str | None = None) -> DataFrame:
    """(page_id, url, strategy, ord, target)."""
    column = F.col(selector) if selector else None
    return _rows(dom, "link", link_targets(column))


def next_by_click(dom: DataFrame) -> DataFrame:
    return _rows(dom, "click", _targets_of_all(CLICK_XPATHS))


def next_by_load_more(dom: DataFrame) -> DataFrame:
    return _rows(dom, "load_more", _targets_of_all(MORE_XPATHS))


def next_by_param(pages: DataFrame) -> DataFrame:
    """Counter heuristic on the page's own URL; needs no markup."""
    targets = F.transform(increment_page_param(F.col("url")), lambda u: normalize_url(u, F.col("url")))
    return _rows(pages, "infinite_scroll", targets)


def _candidate_of(rank: int, strategy: str):
    return lambda t, i: F.struct(
        F.lit(rank).alias("srank"), F.lit(strategy).alias("strategy"), i.alias("ord"), t.alias("target")
    )


def next_candidates(dom: DataFrame, selector: str | None = None) -> DataFrame:
    """All candidates of all strategies in one scan of the page rows."""
    column = F.col(selector) if selector else None
    per = {
        "link": link_targets(column),
        "click": _targets_of_all(CLICK_XPATHS),
        "load_more": _targets_of_all(MORE_XPATHS),
        "infinite_scroll": F.transform(increment_page_param(F.col("url")), lambda u: normalize_url(u, F.col("url"))),
    }
    packed = F.flatten(
        F.array(
            *[
                F.transform(
                    arr,
                    _candidate_of(k, s),
                )
                for k, (s, arr) in enumerate(per.items())
            ]
        )
    )
    return dom.select("page_id", "url", F.explode(packed).alias("c")).select("page_id", "url", "c.*").filter("target IS NOT NULL")


def first_unvisited(
    candidates: DataFrame, visited: DataFrame, key: list[str], visited_key: list[str] | None = None
) -> DataFrame:
    """(key, n_candidates, target): first candidate (by ord) that is not in visited(visited_key, target)."""
    on = [*(visited_key or key), "target"]
    marked = candidates.join(visited.select(*on).distinct().withColumn("old", F.lit(True)), on, "left")
    extra = [c for c in candidates.columns if c not in (*key, "ord", "target")]
    fresh = F.when(F.col("old").isNull(), F.struct("ord", "target", *extra))
    return marked.groupBy(*key).agg(F.count("*").alias("n_candidates"), F.min(fresh).alias("f")).select(
        *key, "n_candidates", F.col("f.target").alias("target"), *[F.col(f"f.{c}").alias(c) for c in extra]
    )


def page_keys(pages: DataFrame) -> DataFrame:
    """(target, to_page, to_url): how a fetch of ``target`` would be answered by the corpus."""
    keyed = pages.select(F.explode(F.array_distinct(F.array("url", F.coalesce(normalize_url(F.col("url")), "url")))).alias("target"), "page_id", "url")
    return keyed.groupBy("target").agg(F.min(F.struct("page_id", "url")).alias("p")).select(
        "target", F.col("p.page_id").alias("to_page"), F.col("p.url").alias("to_url")
    )


def next_page(candidates: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, strategy, target): first strategy whose first new target is in the corpus."""
    fresh = candidates.filter("target <> url")
    first = fresh.groupBy("page_id", "srank", "strategy").agg(F.min(F.struct("ord", "target")).alias("f"))
    present = first.select("page_id", "srank", "strategy", F.col("f.target").alias("target")).join(
        page_keys(pages).select("target"), "target", "left_semi"
    )
    return present.groupBy("page_id").agg(F.min(F.struct("srank", "strategy", "target")).alias("b")).select(
        "page_id", "b.strategy", "b.target"
    )


def has_progress(snapshots: DataFrame, chain: list[str]) -> DataFrame:
    """Add ``progress`` against the previous round: new url, new fingerprint or more anchors."""
    w = W.partitionBy(*chain).orderBy("round")
    prev = lambda c: F.lag(c).over(w)
    changed = (
        (F.col("url") != prev("url"))
        | (F.col("fingerprint") != prev("fingerprint"))
        | (F.col("anchor_count") > prev("anchor_count"))
    )
    return snapshots.withColumn("progress", changed)


def stop_reason(pages: Column, stalled: Column, broke: Column, max_target: int, max_stalled: int) -> Column:
    """Final verdict; ``broke`` tells that a check at the start of a round ended the chain."""
    at_break = F.when(pages >= max_target, "TARGET_REACHED").otherwise("NO_PROGRESS_LIMIT")
    at_end = (
        F.when((pages == 1) & (stalled > 0), "NO_STRATEGY_ADVANCED")
        .when(stalled >= max_stalled, "NO_PROGRESS_LIMIT")
        .when(pages >= max_target, "TARGET_REACHED")
        .otherwise("MAX_ROUNDS")
    )
    return F.when(broke, at_break).otherwise(at_end)


def follow_pagination(
    pages: DataFrame,
    candidates: DataFrame,
    seeds: DataFrame,
    max_rounds: int,
    max_stalled: int = 2,
    max_target: int = 10,
    strategies: tuple[str, ...] = STRATEGIES,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Follow all chains at once: (chain pages, trace, stop reasons).

    ``seeds``: page_id of each start page. ``candidates`` come from
    :func:`next_candidates`. One round is one join of the chains' current pages
    with the candidates and one with the corpus; state is one row per chain.

    chain pages: seed, n, page_id, url. trace: seed, round, srank, strategy,
    candidate_count, target, progress, reason, total_pages.
    """
    modes = F.array(*[F.struct(F.lit(i).alias("srank"), F.lit(s).alias("strategy")) for i, s in enumerate(strategies)])
    place = F.array_position(F.array(*[F.lit(s) for s in strategies]), F.col("strategy")).cast("int") - 1
    # candidates and the pages they lead to are looked up in every round: written once
    cand = cut_lineage(
        candidates.withColumn("srank", place).filter("srank >= 0")
        .join(page_keys(pages), "target", "left")
        .select("page_id", "srank", "ord", "target", "to_page")
    )
    start = seeds.select(F.col("page_id").alias("seed")).join(
        pages.select(F.col("page_id").alias("seed"), "url"), "seed"
    )
    visited = cut_lineage(
        start.select("seed", F.lit(1).alias("n"), F.col("seed").alias("page_id"), "url")
    )
    state = visited.select(
        "seed", "page_id", "url", F.lit(1).alias("pages"), F.lit(0).alias("stalled"), F.lit(False).alias("broke")
    )
    traces = None
    for rnd in range(1, max_rounds + 1):
        ended = (F.col("pages") >= max_target) | (F.col("stalled") >= max_stalled)
        state = state.withColumn("broke", F.col("broke") | ended)
        live = state.filter(~F.col("broke"))
        grid = live.select("seed", "pages", F.inline(modes))
        found = live.select("seed", "page_id").join(cand, "page_id")
        picked = first_unvisited(found, visited.select("seed", F.col("url").alias("target")), ["seed", "srank"], ["seed"])
        tried = grid.join(picked, ["seed", "srank"], "left")
        win = F.min(F.when(F.col("to_page").isNotNull(), F.col("srank"))).over(W.partitionBy("seed"))
        step = cut_lineage(tried.withColumn("win", win).filter("win IS NULL OR srank <= win"))
        won = F.col("srank") == F.col("win")
        reason = (
            F.when(F.col("target").isNull(), "no unvisited candidate")
            .when(F.col("to_page").isNull(), "missing page")
            .otherwise("advanced")
        )
        rows = step.select(
            "seed", F.lit(rnd).alias("round"), "srank", "strategy",
            F.coalesce("n_candidates", F.lit(0)).alias("candidate_count"), "target",
            F.coalesce(won, F.lit(False)).alias("progress"), reason.alias("reason"),
            (F.col("pages") + F.when(won, 1).otherwise(0)).cast("int").alias("total_pages"),
        )
        traces = rows if traces is None else traces.unionByName(rows)
        moved = step.filter(won).select("seed", F.col("to_page").alias("new_page"), F.col("target").alias("new_url"))
        state = cut_lineage(
            state.join(moved, "seed", "left").select(
                "seed",
                F.coalesce("new_page", "page_id").alias("page_id"),
                F.coalesce("new_url", "url").alias("url"),
                (F.col("pages") + F.when(F.col("new_page").isNotNull(), 1).otherwise(0)).alias("pages"),
                F.when(F.col("broke"), F.col("stalled")).when(F.col("new_page").isNotNull(), 0).otherwise(F.col("stalled") + 1).alias("stalled"),
                "broke",
            )
        )
        visited = visited.unionByName(
            moved.join(state.select("seed", "pages"), "seed").select(
                "seed", F.col("pages").alias("n"), F.col("new_page").alias("page_id"), F.col("new_url").alias("url")
            )
        )
        if state.filter(~F.col("broke")).isEmpty():
            break
    stops = state.select(
        "seed", "pages",
        stop_reason(F.col("pages"), F.col("stalled"), F.col("broke"), max_target, max_stalled).alias("stop_reason"),
    )
    if traces is None:
        traces = visited.limit(0).selectExpr(
            "seed", "0 AS round", "0 AS srank", "'' AS strategy", "0L AS candidate_count", "url AS target",
            "false AS progress", "'' AS reason", "0 AS total_pages",
        )
    return visited, traces, stops
