"""A shop site derived from the ``orders`` table: one page per order and archive lists.

The markup expressions are plain SQL that Spark and DuckDB both read, so both
sides of a check see the same pages. Archive list ``n`` holds the orders with
``o_orderkey`` in [20n, 20n + 20); ten lists form one chain of next links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = "CAST(o_orderkey AS STRING)"
HOST = "concat('https://shop', CAST((o_orderkey // 200) % 7 AS STRING), '.example.com')"
PRICE = "CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING)"
LIST_BASE = 10_000_000_000

DETAIL_URL = f"concat({HOST}, '/order/', {KEY})"
DETAIL_HTML = f"""concat(
 '<html><head><title>Order ', {KEY}, '</title></head><body><nav id="top"><a href="/about">About</a>',
 '<a href="/archive/', CAST(o_orderkey // 200 AS STRING), '?page=1">Archive</a></nav>',
 '<div class="main" id="main"><h1 data-testid="order-title">Order ', {KEY}, '</h1>',
 '<span class="price">$ ', {PRICE}, '</span><span class="status st-', o_orderstatus, '" hidden>', o_orderstatus, '</span>',
 CASE WHEN o_orderpriority = '1-URGENT' THEN '<b class="flag" style="display:none">urgent</b>!' ELSE '' END,
 '<div class="body"><p>Placed by ', CAST(o_custkey AS STRING), '</p><p>Copyright</p><p>Copyright</p><p> </p></div>',
 '<a class="prev" href="/order/', CAST(o_orderkey - 1 AS STRING), '">previous</a><i></i>',
 '<a href="/files/', {KEY}, '.pdf">invoice</a></div><!-- end --><footer>shop &amp; co</footer></body></html>')"""

LIST_NO = "o_orderkey // 20"
CARD = f"""concat('<li class="card st-', o_orderstatus, CASE WHEN o_totalprice > 200000 THEN ' hot' ELSE '' END,
 CASE WHEN o_orderkey % 20 = 7 THEN ' pick-of-day' ELSE '' END, '" data-sku="SKU.', {KEY},
 '" data-kind="', o_orderpriority, '" data-unit="pc."><a class="lnk" href="/order/', {KEY}, '">Order ', {KEY},
 '</a><span class="cost">$ ', {PRICE}, '</span></li>')"""
LIST_URL = "concat('https://shop', CAST((n // 10) % 7 AS STRING), '.example.com/archive/', CAST(n // 10 AS STRING), '?page=', CAST(n % 10 + 1 AS STRING))"
LIST_HTML = """concat('<html><body><div class="menu"><a href="/about">About</a><a href="/contact">Contact</a></div>',
 '<ul class="cards">', cards, '</ul>',
 CASE WHEN n % 10 < 9 THEN concat('<a class="next" href="?page=', CAST(n % 10 + 2 AS STRING), '">下一页</a>') ELSE '' END,
 '<button class="load_more" data-url="/more/', CAST(n AS STRING), '">加载更多</button></body></html>')"""

ORDER_PAGES_SQL = f"SELECT o_orderkey AS page_id, {DETAIL_URL} AS url, {DETAIL_HTML} AS html FROM orders"
LIST_PAGES_SQL = (
    f"SELECT n + {LIST_BASE} AS page_id, {LIST_URL} AS url, {LIST_HTML} AS html FROM ("
    f"SELECT {LIST_NO} AS n, string_agg({CARD}, '' ORDER BY o_orderkey) AS cards FROM orders GROUP BY 1)"
)


def _spark(expr: str) -> str:
    return expr.replace("//", " DIV ").replace("https: DIV ", "https://")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_by(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    """Orders spread over all cores: markup is much larger than the rows it is made of."""
    orders = read(spark, sf_dir, "orders").withColumn("k", F.expr(key))
    return orders.repartition(spark.sparkContext.defaultParallelism, "k")


def order_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_by(spark, sf_dir, "o_orderkey").selectExpr(
        "o_orderkey AS page_id", f"{_spark(DETAIL_URL)} AS url", f"{_spark(DETAIL_HTML)} AS html"
    )


def list_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every list holds at most twenty orders, so the grouping is bounded by construction."""
    rows = orders_by(spark, sf_dir, _spark(LIST_NO)).selectExpr("k AS n", "o_orderkey", f"{_spark(CARD)} AS card")
    cards = rows.groupBy("n").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "card"))).alias("c"))
    joined = cards.select("n", F.array_join(F.transform("c", lambda x: x["card"]), "").alias("cards"))
    return joined.selectExpr(f"n + {LIST_BASE} AS page_id", f"{_spark(LIST_URL)} AS url", f"{_spark(LIST_HTML)} AS html")


def shop_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_pages(spark, sf_dir).unionByName(list_pages(spark, sf_dir))
