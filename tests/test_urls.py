import pytest
from pyspark.sql import functions as F

from webcorpus.functions import text as tx
from webcorpus.functions import urls as u

CASES = [
    (" /a ", "https://Ex.com/x/y", "https://ex.com/a"),
    ("../z?q=1#f", "https://ex.com/x/y/", "https://ex.com/x/z?q=1"),
    ("//CDN.ex.com", "http://ex.com/", "http://cdn.ex.com/"),
    ("HTTP://EX.com", None, "http://ex.com/"),
    ("?page=2", "https://example.com/list?page=1", "https://example.com/list?page=2"),
    ("c/./d", "https://ex.com/a/b", "https://ex.com/a/c/d"),
    ("../../../c", "https://ex.com/a/b", "https://ex.com/c"),
    ("foo:bar", "https://ex.com/", None), ("ftp://ex.com/a", "https://ex.com/", None),
    ("JavaScript:x()", "https://ex.com/", None), ("#top", "https://ex.com/", None),
    ("", "https://ex.com/", None), (None, "https://ex.com/", None), ("rel", None, None),
]


def test_normalize(spark):
    rows = [(i, a, b) for i, (a, b, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, href string, base string")
    once = df.withColumn("u", u.normalize_url(F.col("href"), F.col("base")))
    got = once.withColumn("again", u.normalize_url(F.col("u"))).orderBy("i").collect()
    assert [r.u for r in got] == [c[2] for c in CASES]
    assert all(r.u == r.again for r in got)


def test_link_to_itself(spark):
    df = spark.createDataFrame([("#top",), ("",), ("mailto:x@y",)], "h string")
    out = df.select(u.link_url(F.col("h"), F.lit("https://ex.com/a?b=1")).alias("u")).collect()
    assert [r.u for r in out] == ["https://ex.com/a?b=1", "https://ex.com/a?b=1", None]


def test_page_counter(spark):
    urls = ["https://m.example.net/en/25#top", "https://m.example.net/fr/825?page=2&ref=x", "https://a.com/?pn=9&page=a&start=0&pn=1"]
    df = spark.createDataFrame([(x,) for x in urls], "url string")
    raw = [r.c for r in df.select(u.increment_page_param(F.col("url")).alias("c")).collect()]
    assert raw[0] == ["https://m.example.net/en/25#top?page=2"]
    assert raw[1] == ["https://m.example.net/fr/825?page=3&ref=x"]
    assert raw[2] == ["https://a.com/?pn=2&page=a&start=0", "https://a.com/?pn=1&page=a&start=1"]
    assert spark.createDataFrame([(raw[0][0],)], "x string").select(u.normalize_url(F.col("x"))).first()[0] == "https://m.example.net/en/25"


@pytest.mark.parametrize(
    "token, expected",
    [("css-3fJ8kL", True), ("nav-item", True), ("load_more", True), ("card", False), ("0a1b2c3d", True), ("12", True), ("x", False)],
)
def test_random_token(spark, token, expected):
    assert spark.createDataFrame([(token,)], "t string").select(tx.is_random_token(F.col("t"))).first()[0] is expected


def test_similarity_and_entities(spark):
    df = spark.createDataFrame([("price", "prices"), ("price", "prjce"), ("abc", "xyzzy9"), ("ab", "abcdef")], "a string, b string")
    assert [r[0] for r in df.select(tx.is_similar(F.col("a"), F.col("b"))).collect()] == [True, True, False, True]
    text = spark.createDataFrame([("a &amp;lt; &#8364;&nbsp;b",)], "t string")
    assert text.select(tx.decode_entities(F.col("t"))).first()[0] == "a &lt; € b"
    assert text.select(tx.normalize_text(F.lit(" a  \n b "))).first()[0] == "a b"


def test_references_of_any_form(spark):
    cases = {
        "&#9999999;|&#55296;|&#0;": "\ufffd|\ufffd|\ufffd", "&#0000000065;&#x41;&#X1F600;": "AA\U0001f600", "&rsquo;&Auml;&nope;": "\u2019\u00c4&nope;",
        "&amp;lt; &#38;lt; &": "&lt; &lt; &", "a": "a",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.d for r in df.select("t", tx.decode_entities(F.col("t")).alias("d")).collect()} == cases


def test_numbers_of_any_length(spark):
    cases = {"9": "10", "007": "8", "9" * 45: "1" + "0" * 45, "12" * 30: "12" * 29 + "13", "0": "1", "1099": "1100"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.d for r in df.select("t", u.plus_one(F.col("t")).alias("d")).collect()} == cases
