import random

from webcorpus.llm.langid import _agreed, dictionaries, identify, letters

SOUNDS = {"aa": ["ka", "lo", "mi", "tu", "ra"], "bb": ["sch", "ung", "ein", "ver", "pfl"]}


def text(rng, lang, words):
    return " ".join("".join(rng.choice(SOUNDS[lang]) for _ in range(rng.randint(1, 4))) for _ in range(words))


def test_held_out_accuracy(spark, docs):
    rng = random.Random(1)
    known = [(text(rng, lang, 80), lang) for lang in SOUNDS for _ in range(60)] + [(None, "aa"), ("", "bb"), ("x", None)]
    content = dictionaries(spark.createDataFrame(known, "text string, lang string"))
    assert set(content) == set(SOUNDS)
    asked = [(i, text(rng, lang, 30)) for i, lang in enumerate(list(SOUNDS) * 50)]
    got = {r.doc_id: r for r in identify(docs(asked), content).collect()}
    right = sum(got[i].lang_pred == lang for i, lang in enumerate(list(SOUNDS) * 50))
    assert right >= 98 and all(0 <= r.score <= 1 for r in got.values())
    assert all(r.rejected == (r.score < 0.005) for r in got.values())


def test_copies_do_not_thin_a_language(spark):
    rng = random.Random(2)
    few = [text(rng, "aa", 80) for _ in range(5)]
    known = [(few[i % 5], "aa") for i in range(40_000)] + [(text(rng, "bb", 80), "bb") for _ in range(100)]
    content = dictionaries(spark.createDataFrame(known, "text string, lang string"))
    assert list(content) == ["aa", "bb"] and all(t.encode() in content["aa"] for t in few)


def test_short_texts_fill_the_dictionary(spark):
    rng = random.Random(3)
    known = [(text(rng, "aa", 3) + f" {i}", "aa") for i in range(20_000)]
    assert len(dictionaries(spark.createDataFrame(known, "text string, lang string"), size=20_000)["aa"]) >= 20_000


def test_a_language_of_few_texts_stays():
    rng = random.Random(4)
    large = [("bb", text(rng, "bb", 80).encode()) for _ in range(400)]
    few = [("cc", text(rng, "bb", 4).encode()) for _ in range(6)]  # the other half denies them
    kept = _agreed(large[:200] + few + large[200:])
    assert [x for x in kept if x[0] == "cc"] == few
    wrong = [("aa", large[0][1]), *[("aa", text(rng, "aa", 80).encode()) for _ in range(60)]]
    assert ("aa", large[0][1]) not in _agreed(large + wrong)


def test_edges(spark, docs, edge_rows):
    none = dictionaries(spark.createDataFrame([(None, "aa"), ("x", None)], "text string, lang string"))
    assert none == {}
    rows = edge_rows + [(11, "12 34 !?")]
    assert {r.lang_pred for r in identify(docs(rows), none).collect()} == {"und"}
    got = identify(docs(rows), {"aa": b"a b c", "bb": b"zzz"}).collect()
    assert len(got) == len(rows)
    assert {r.doc_id for r in got if r.lang_pred == "und"} == {None, 1, 2, 3, 11}
    same = [r.lang_pred for r in got if r.doc_id == 5]
    assert same == ["aa", "aa"] and identify(docs([]), {"aa": b"a"}).count() == 0


def test_letters_are_what_unicode_calls_letters():
    for text in ["½ ² Ⅷ ５ 7 _ ①", "x²½y Été 中文一 Ⅷ", "", "İstanbul 3ª"]:
        want = "".join(c if c.isalpha() else " " for c in text.lower()).split()
        assert letters(text).decode() == " ".join(want)


def test_texts_of_number_signs_have_no_language(spark, docs):
    content = {"aa": b"ka lo mi" * 50, "bb": b"sch ung ein" * 50}
    got = {r.doc_id: r.lang_pred for r in identify(docs([(1, "½ ² Ⅷ"), (2, "ka lo mi")]), content).collect()}
    assert got == {1: "und", 2: "aa"}


def test_letters_take_no_time_for_signs_that_are_not_there():
    import time

    from webcorpus.llm.langid import letters

    text, start = "Grüße an alle Wörter " * 60_000, time.process_time()
    assert letters(text) == ("grüße an alle wörter " * 60_000).strip().encode()
    assert time.process_time() - start < 1
