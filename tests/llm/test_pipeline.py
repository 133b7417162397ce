import corpus_pipeline as p
from webcorpus.llm.common import stage

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    benchmark = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    seen = set(texts)
    for name, apply in p.STAGES[:-1]:
        out = stage(apply(spark, docs, SF))
        assert out.columns == docs.columns, name
        rows = {r.doc_id: r for r in out.collect()}
        assert set(rows) <= seen and len(rows) == out.count()
        seen, docs = set(rows), out
    assert all(r.n_chars == len(r.text) for r in rows.values())
    flat = {i: " ".join(r.text.lower().split()) for i, r in rows.items()}
    assert not any(item in text for item in benchmark for text in flat.values())
    packed = p.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == seen
    assert sum(r.length for r in p.run(spark, SF).collect()) == sum(r.length for r in packed)


def test_lines_stage_drops_only_what_is_left_empty(spark):
    rows = [(1, "a\nb\nc", "en", "s", 5), (2, "a\nb\nc", "en", "s", 5), (3, "a\nb\nc\nd", "en", "s", 7), (4, None, "en", "s", None), (5, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in p.lines(spark, docs, "").collect()}
    assert got[1] == ("a\nb\nc", 5) and got[3] == ("d", 1) and 2 not in got and got[4] == (None, None)
