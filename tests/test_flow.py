import os
import tempfile

from pyspark.sql import functions as F

from webcorpus.operators import graph, heal, health, paginate, responses, shred
from webcorpus.sources import tables
from webcorpus.streaming import monitor

CASES = {
    "v0": (["v", None], False), "0 0 v": ([None, None, "v"], True), "v00v": (["v", None, None, "v"], False),
    "v00v0": (["v", None, None, "v", None], False), "00v00": ([None, None, "v", None, None], True),
    "vvv000": (["v", "v", "v", None, None, None], True),
}


def history(spark):
    rows = [(k, "f", i, v) for k, (vals, _) in CASES.items() for i, v in enumerate(vals)]
    return spark.createDataFrame(rows, "template_id string, field string, seq long, value string")


def test_health_flags(spark):
    flags = health.needs_healing(history(spark))
    last = flags.groupBy("template_id").agg(F.max_by("flagged", "seq").alias("f"))
    assert {r.template_id: r.f for r in last.collect()} == {k: v for k, (_, v) in CASES.items()}


def test_health_across_blocks(spark, monkeypatch):
    rows = [("t", "f", i * 3, None if (i * 7919) % 5 < 3 else str(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "template_id string, field string, seq long, value string")
    whole = sorted(map(tuple, health.needs_healing(df).collect()))
    windows = {r.seq: (r.results, r.samples) for r in health.health_window(df).collect()}
    monkeypatch.setattr(health, "BLOCK", 7)
    assert sorted(map(tuple, health.needs_healing(df).collect())) == whole
    assert {r.seq: (r.results, r.samples) for r in health.health_window(df).collect()} == windows
    seen = [v for *_, v in rows]
    assert windows[150] == (seen[41:51], [v for v in seen[:51] if v is not None][-5:])


def test_blocks_follow_rows_not_seq(spark, monkeypatch):
    monkeypatch.setattr(health, "BLOCK", 100)
    h = spark.range(1000).selectExpr("'t' AS template_id", "'f' AS field", "id * 100000 AS seq", "IF(id % 3 = 0, NULL, 'v') AS value")
    placed = health.with_position(h)
    assert {r.seq: r.pos for r in placed.collect()} == {i * 100000: i + 1 for i in range(1000)}
    plain = health.needs_healing(h.withColumn("seq", (F.col("seq") / 100000).cast("long")))
    flags = lambda d, by: [(r.seq // by, r.flagged) for r in d.orderBy("seq").collect()]
    assert flags(health.needs_healing(h), 100000) == flags(plain, 1)


def test_cascade(spark):
    f = spark.createDataFrame([("a", 1, True), ("a", 1, False), ("b", 1, True), ("b", 1, True), ("b", 1, False)], "template_id string, seq long, flagged boolean")
    assert {r.template_id: r.cascade for r in health.cascade_failure(f).collect()} == {"a": False, "b": True}


def test_stream_equals_batch(spark):
    root = tempfile.mkdtemp(prefix="webcorpus-test-")
    src, out, chk = (os.path.join(root, x) for x in ("src", "out", "chk"))
    h = history(spark).withColumn("event", F.lit("seen"))
    h.filter("seq < 2").coalesce(1).write.mode("append").parquet(src)
    h.filter("seq >= 2").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(h.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = monitor.monitor_stream(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", chk).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.parquet(out).select("template_id", "seq", "flagged")
    want = health.needs_healing(history(spark)).select("template_id", "seq", "flagged")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def follow(spark, pages, **cfg):
    seeds = pages.filter("page_id = 0").select("page_id")
    return paginate.follow_pagination(pages, paginate.next_candidates(shred.shred_html(pages)), seeds, **cfg)


def test_pagination(spark):
    site = "https://shop.example.org/shoes?page="
    rows = [(i, f"{site}{i + 1}", f"<a class='next' href='?page={i + 2}'>more</a><p>{i}</p>") for i in range(4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    chain, trace, stop = follow(spark, df, max_rounds=3, max_stalled=2, max_target=9)
    assert chain.count() == 4 and stop.first().stop_reason == "MAX_ROUNDS"
    assert [r.progress for r in trace.filter("progress").collect()] == [True] * 3
    chain, trace, stop = follow(spark, df, max_rounds=8, max_stalled=2, max_target=9)
    assert chain.count() == 4 and trace.filter("NOT progress AND reason = 'missing page'").count() > 0
    alone = spark.createDataFrame([(0, "https://shop.example.org/hats", "<h1>hats</h1>")], df.schema)
    kinds = dict(strategies=("click", "load_more"))
    assert follow(spark, alone, max_rounds=5, max_stalled=2, **kinds)[2].first().stop_reason == "NO_PROGRESS_LIMIT"
    assert follow(spark, alone, max_rounds=4, max_target=1)[2].first().stop_reason == "TARGET_REACHED"


def test_frontier(spark):
    u = lambda x: f"https://h.com/{x}"
    e = [(u(a), i, u(b)) for i, (a, b) in enumerate(("ab", "bc", "ca", "cd", "de"))] + [(u("c"), 9, "https://o.com/x")]
    edges = spark.createDataFrame(e, "src string, ord int, dst string")
    got = graph.crawl_frontier(edges, spark.createDataFrame([(u("a"),)], "url string"), 3)
    assert {r.url[-1]: r.depth for r in got.collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}
    assert graph.crawl_frontier(edges, spark.createDataFrame([(u("a"),)], "url string"), 3, 2).count() == 2


def test_sitemaps(spark):
    loc = "<url><loc> /a </loc></url><url><loc>https://x.com/b?c=1&amp;d=2</loc></url>"
    rows = [(0, f"<urlset>{loc}</urlset>"), (1, f'<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">{loc}</urlset>'),
            (2, "<sitemapindex><sitemap><loc>https://x.com/s.xml</loc></sitemap></sitemapindex>"), (3, f"<urlset>{loc}")]
    df = spark.createDataFrame(rows, "site int, xml string").withColumn("base_url", F.lit("https://h.com"))
    got = [(r.site, r.url) for r in graph.parse_sitemaps(df).orderBy("site", "ord").collect()]
    urls = ["https://h.com/a", "https://x.com/b?c=1&d=2"]
    assert got == [(0, urls[0]), (0, urls[1]), (1, urls[0]), (1, urls[1])]


def test_sitemaps_are_read_as_xml(spark):
    rows = [
        (0, "<urlset><!-- <x> --><url><loc><![CDATA[https://x.com/?a&b]]></loc></url><url><loc>/c&#38;d</loc></url></urlset>"),
        (1, "<urlset><url><loc>https://x.com/?a&b</loc></url></urlset>"), (2, None),
        (3, '<s:urlset xmlns:s="u"><s:url><s:loc>/e</s:loc></s:url></s:urlset>'),
    ]
    df = spark.createDataFrame(rows, "site int, xml string").withColumn("base_url", F.lit("https://h.com"))
    got = [(r.site, r.url) for r in graph.parse_sitemaps(df).orderBy("site", "ord").collect()]
    assert [s for s, _ in got] == [0, 0, 3] and got[1][1] == "https://h.com/c&d"


def test_repair_takes_the_fallback_of_its_source(spark):
    sel = spark.createDataFrame([("t", f, "//a", "//old", 0.9) for f in "xy"], "template_id string, field string, xpath string, fallback_xpath string, confidence double")
    rep = spark.createDataFrame(
        [("t", "x", "//n", None, 0.7, "induced"), ("t", "y", "//n", None, 0.7, "code")],
        "template_id string, field string, new_xpath string, new_fallback string, new_confidence double, new_source string",
    )
    assert {r.field: r.fallback_xpath for r in heal.apply_repairs(sel, rep).collect()} == {"x": None, "y": "//old"}


def test_answers(spark):
    rows = [
        (0, "page_type", 0, '```\n{"confidence": 0.81, "page_type": "list"}\n```'),
        (1, "page_type", 0, '{"page_type": "list", "confidence": 0.5}'), (1, "page_type", 1, '{"page_type": "detail", "confidence": 0.6}'),
        (2, "page_type", 0, '{"page_type": "list", "confidence": 0.5}'), (2, "page_type", 1, '{"page_type": "detail", "confidence": 0.9}'),
        (3, "page_type", 0, "not json"),
        (0, "list_fields", 0, '{"primary_detail_link_xpath": "//td[@data-aid=\'e7\']/a/@href", "detail_link_xpath_candidates": [{"xpath": " "}, {"xpath": "//table//td/a/@href"}]}'),
    ]
    df = spark.createDataFrame(rows, "page_id long, prompt_kind string, attempt int, content string")
    picked = {r.page_id: (r.page_type, r.use_legacy) for r in responses.pick_detection(responses.parse_page_type(df)).collect()}
    assert picked == {0: ("list", False), 1: ("detail", True), 2: ("detail", False)}
    els = spark.createDataFrame([(0, "e0")], "page_id long, aid string")
    head, cand = responses.parse_list_response(df, els)
    assert [(r.xpath, r.confidence) for r in cand.collect()] == [("//table//td/a/@href", 0.5)]
    assert head.first().primary == "//table//td/a/@href"


def test_read_and_write(spark):
    root = tempfile.mkdtemp(prefix="webcorpus-test-")
    df = spark.createDataFrame([(1, "https://x.com/", "<p>ü</p>"), (2, None, "x"), (3, "https://y.com/", "")], "page_id long, url string, html string")
    df.write.parquet(f"{root}/p")
    assert tables.read_pages(spark, f"{root}/p").count() == 1
    rec = df.filter("page_id = 1").select("url", F.create_map(F.lit("t"), F.lit("ü")).alias("data"))
    tables.write_records(rec, f"{root}/r")
    assert "ü" in "".join(r.value for r in spark.read.text(f"{root}/r").collect())
    q = tables.stream_pages(spark, f"{root}/p").writeStream.format("memory").queryName("streamed").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("streamed").count() == 1


def test_sides_made_of_pages_are_not_broadcast_by_estimate(spark, tmp_path):
    """The table is small and so are Spark's estimates of what is made of it; its elements need not be."""
    import entry_queries

    sql = "id * 7 AS o_orderkey, 5D AS o_totalprice, 'O' AS o_orderstatus, '1-URGENT' AS o_orderpriority, 3 AS o_custkey"
    spark.range(40).selectExpr(*sql.split(", ")).write.parquet(str(tmp_path / "orders.parquet"))
    for name in ("fields_parsed", "list_headers", "similar_siblings", "selectors_validated", "element_contexts"):
        plan = entry_queries.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert "Join" in plan and "BroadcastExchange" not in plan, name


def test_join_small_measures_what_spark_estimates_too_low(spark, monkeypatch, tmp_path):
    from webcorpus import session

    spark.range(3).write.parquet(str(tmp_path / "few"))
    small = spark.read.parquet(str(tmp_path / "few")).select("id", F.explode(F.sequence(F.lit(1), F.lit(50))).alias("x"))
    monkeypatch.setattr(session, "BROADCAST_BYTES", 100)
    joined = session.join_small(spark.range(5).toDF("id"), small, ["id"], "id")
    assert "BroadcastExchange" not in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.groupBy("id").count().orderBy("id").collect() == [(0, 50), (1, 50), (2, 50)]
