import random

import pytest

from webcorpus.llm.html_blocks import features, text_blocks
from webcorpus.llm.html_examples import PAGES
from webcorpus.llm.html_extract import extract_main_text, is_main, main_text, train_tree


@pytest.fixture(scope="module")
def tree(spark):
    return train_tree(spark)


def test_labelled_pages_are_told_apart(tree):
    wrong = [
        (b.text, b.label) for page in PAGES for blocks in [text_blocks(page)]
        for b, row in zip(blocks, features(blocks)) if is_main(tree, row) != b.label
    ]
    assert len(wrong) <= 2, wrong


def test_a_page(tree):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav><!-- ad --><div class="ad">Buy this now for your own good.</div>
    <article><h1>A&amp;B</h1><p><b>First &lt;part&gt;<br>goes   on<p>Second&nbsp;part &copy 2</p><p></p></article>
    <form><label>Name</label><input></form><footer>&copy; x.org &middot; all rights</footer></body></html>"""
    assert main_text(tree, page) == "A&B\nFirst <part> goes on\nSecond part © 2"


def test_blocks_of_broken_markup():
    texts = lambda html: [b.text for b in text_blocks(html)]
    assert texts("a < b <p>c") == ["a < b", "c"]
    assert texts("<p title='x>y'>a</p><p title=\"b") == ["a", "<p title=\"b"]
    assert texts("x<!-- y") == ["x"] and texts("x<script>y") == ["x"] and texts("<ul><li>a<li>b</ul>c") == ["a", "b", "c"]
    assert texts("<a href=x>l<a href=y>m") == ["lm"] and texts("</p></div>z") == ["z"] and texts("") == []
    assert text_blocks("<a href=x>one two</a> three")[0].linked == 2
    rng = random.Random(1)
    bits = ["<p>", "</p>", "<b>", "</b>", "<div class='", "'>", "<a href=x>", "</a>", "text", "&amp", "<", ">", "<!--", "-->", "<li>", "<table><td>", "</"]
    for _ in range(2000):
        text_blocks("".join(rng.choice(bits) for _ in range(rng.randint(0, 30))))


BODY = "The river had been rising for three days when the council met in the old hall. " * 3


@pytest.mark.parametrize("said", ['class="layout has-sidebar"', 'class="no-sidebar"', 'class="right-rail"', 'id="community-page"', 'class="has-comments"'])
def test_wrappers_with_words_against(tree, said):
    page = f"<html><body><nav><a href=x>Home</a></nav><div {said}><article><p>{BODY}</p></article><div class=sidebar><p>Ten ways to dry a cellar.</p></div></div></body></html>"
    assert main_text(tree, page) == BODY.strip()
    if "comments" not in said:
        assert main_text(tree, page.replace("article>", "section>")) == BODY.strip()


def test_what_speaks_against_stays(tree):
    page = f"<body><article><p>{BODY}</p></article>" + f"<div class=comments><p>{BODY * 4}</p></div><div class=newsletter><p>{BODY * 4}</p></div>"
    assert main_text(tree, page) == BODY.strip()
    assert main_text(tree, f"<body><div hidden><article><p>{BODY}</p></article></div></body>") == ""
    assert main_text(tree, f"<body><div class=comments><p>{BODY}</p></div></body>") == ""


def test_text_of_formulas_and_drawings(tree):
    page = f"<body><article><p>{BODY} <math><mi>x</mi><mo>=</mo><mn>2</mn></math> <svg><style>a</style><text>flood</text></svg> <object>map</object></p></article></body>"
    assert main_text(tree, page).endswith("x=2 flood map")


def test_many_marks_take_linear_time(tree):
    assert main_text(tree, "<div class=sidebar>" * 60_000 + "<p>x") in ("", "x")


def test_many_open_tags_take_linear_time(tree):
    assert main_text(tree, "<b>" * 60_000 + "<article><p>x</p></article>" + "</i>" * 60_000) == "x"


def test_table(spark, tree):
    rows = [(1, "u", "<p>x</p>" * 3), (2, None, None), (3, "u", ""), (None, "u", "<nav>x</nav>"), (1, "u", "<p>x</p>" * 3)]
    pages = spark.createDataFrame([(*r, "y", "z") for r in rows], "page_id long, url string, html string, text string, HTML string")
    got = extract_main_text(pages, tree).collect()
    assert len(got) == 5 and all(r.n_chars == len(r.text) for r in got)
    assert {r.page_id: r.text for r in got if r.page_id in (2, 3)} == {2: "", 3: ""}
    assert extract_main_text(pages.limit(0), tree).count() == 0


def test_letters_that_grow_in_lower_case_move_nothing():
    page = "İ" * 40 + "<SCRIPT>x=1</SCRIPT><p>First</p><style>p{}</STYLE><p>Second paragraph here.</p>"
    assert [b.text for b in text_blocks(page)] == ["İ" * 40, "First", "Second paragraph here."]
