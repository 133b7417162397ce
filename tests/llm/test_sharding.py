import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from webcorpus.llm.sharding import rendezvous, shard_records


def test_slots_are_gapless_and_a_new_shard_only_takes(docs, edge_rows):
    rows = edge_rows + [(i, f"text {i}") for i in range(100, 1100)]
    got = shard_records(docs(rows), [1.0] * 16).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, len((t or "").encode()) + 1) for i, t in rows)
    for shard in {r.shard for r in got}:
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert all(r.grown_shard in (r.shard, 16) for r in got)
    assert 0.02 < sum(r.grown_shard == 16 for r in got) / len(got) < 0.12
    crc = {(r.doc_id, r.text_crc32) for r in got}
    assert crc == {(i, None if t is None else zlib.crc32(t.encode())) for i, t in rows}
    assert len({(r.doc_id, r.shard) for r in got}) == len({i for i, _ in rows})


def test_weights_decide_shares_and_changes(spark):
    keys = spark.range(20_000)
    old, new = rendezvous(F.col("id"), [1.0, 1.0, 2.0, 0.0]), rendezvous(F.col("id"), [1.0, 1.0, 1.0, 0.0])
    n = {r.s: r["count"] for r in keys.groupBy(old.alias("s")).count().collect()}
    assert 3 not in n and abs(n[2] / 20_000 - 0.5) < 0.02
    assert keys.where((old != new) & (old != 2)).count() == 0
    assert keys.select(rendezvous(F.col("id"), [3.0]).alias("s")).distinct().collect()[0].s == 0


def test_empty_and_wrong_weights(docs, spark):
    assert shard_records(docs([]), [1.0, 1.0]).count() == 0
    for weights in ([], [0.0], [1.0, -1.0]):
        with pytest.raises(ValueError):
            rendezvous(F.col("id"), weights)
