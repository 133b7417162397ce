import os
import tempfile
import types

import pandas as pd
from pyspark.sql import functions as F

from webcorpus.operators import health
from webcorpus.streaming import monitor

DDL = "template_id string, field string, seq long, value string, event string, at timestamp"
START = 1_700_000_000


def observed(spark, rows):
    """Rows (template, seq, value) or (template, seq, value, event); one second apart by seq."""
    full = [(t, "f", s, v, (more or ["seen"])[0], START + s) for t, s, v, *more in rows]
    df = spark.createDataFrame(full, DDL.replace("at timestamp", "at long"))
    return df.withColumn("at", F.timestamp_seconds("at"))


class Feed:
    """A folder that a stream reads file by file, in the order they were added."""

    def __init__(self, spark):
        self.spark, self.root = spark, tempfile.mkdtemp(prefix="webcorpus-test-")

    def add(self, df):
        df.coalesce(1).write.mode("append").parquet(os.path.join(self.root, "in"))

    def run(self, make):
        stream = self.spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).parquet(os.path.join(self.root, "in"))
        out = os.path.join(self.root, "out")
        query = make(stream).writeStream.format("parquet").option("path", out)
        query.option("checkpointLocation", os.path.join(self.root, "chk")).trigger(availableNow=True).start().awaitTermination()
        return self.spark.read.parquet(out)


def tick(spark, seq):
    return observed(spark, [("-", seq, None, "tick")])


def values(n, keys="ab"):
    return [(k, i, None if (i * 7919 + ord(k)) % 5 < 3 else f"{k}{i}") for i in range(n) for k in keys]


def flags(df):
    return sorted((r.template_id, r.seq, r.value, r.flagged) for r in df.collect())


def test_rows_out_of_order_equal_the_batch(spark):
    rows = values(40)
    want = flags(health.needs_healing(observed(spark, rows)))
    feed = Feed(spark)
    for part in ([r for r in rows if r[1] % 3 == 1], [r for r in rows if r[1] % 3 == 0], [r for r in rows if r[1] % 3 == 2]):
        feed.add(observed(spark, part))
    feed.add(tick(spark, 400))
    assert flags(feed.run(lambda s: monitor.monitor_ordered(s, "60 seconds"))) == want


def test_state_of_a_batch_carries_on_and_a_restart_keeps_it(spark):
    rows = values(30)
    want = flags(health.needs_healing(observed(spark, rows)).where("seq >= 14"))
    initial = monitor.batch_state(observed(spark, [r for r in rows if r[1] < 14]))
    make = lambda s: monitor.monitor_ordered(s, "5 seconds", initial=initial)
    feed = Feed(spark)
    feed.add(observed(spark, [r for r in rows if 14 <= r[1] < 22 and r[1] % 2]))
    feed.add(observed(spark, [r for r in rows if 14 <= r[1] < 22 and r[1] % 2 == 0]))
    feed.run(make)
    feed.add(observed(spark, [r for r in rows if r[1] >= 22]))
    feed.add(tick(spark, 300))
    assert flags(feed.run(make)) == want


def test_repairs_and_late_rows(spark):
    feed = Feed(spark)
    feed.add(observed(spark, [("t", i, None) for i in range(3)] + [("t", 3, None, "attempt")]))
    feed.add(tick(spark, 90))
    feed.add(tick(spark, 100))  # rows pass in the batch after the one that moved the watermark
    feed.add(observed(spark, [("t", 1, "too late"), ("t", 101, None, "healed"), ("t", 102, None), ("t", 103, "v")]))
    feed.add(tick(spark, 200))
    out = feed.run(lambda s: monitor.monitor_ordered(s, "5 seconds"))
    got = sorted((r.seq, r.value, r.flagged, r.attempts) for r in out.collect())
    assert got == [(0, None, False, 0), (1, None, False, 0), (2, None, True, 0), (102, None, False, 0), (103, "v", False, 0)]


def test_idle_keys_are_forgotten(spark):
    feed = Feed(spark)
    feed.add(observed(spark, [("t", 0, None), ("t", 1, None), ("u", 1, None)]))
    feed.add(tick(spark, 50))
    feed.add(observed(spark, [("u", 52, None)]))
    feed.add(tick(spark, 120))
    feed.add(observed(spark, [("t", 130, None), ("u", 130, None)]))
    feed.add(tick(spark, 200))
    out = feed.run(lambda s: monitor.monitor_ordered(s, "1 second", idle_ms=80_000))
    got = {(r.template_id, r.seq): r.flagged for r in out.collect()}
    assert got == {("t", 0): False, ("t", 1): False, ("u", 1): False, ("u", 52): False, ("t", 130): False, ("u", 130): True}


class Held:
    """State and handle of one key outside Spark."""

    def __init__(self):
        self.rows, self.timers = [], []

    def get(self):
        return iter(self.rows)

    def exists(self):
        return False

    def put(self, rows):
        self.rows = list(rows)

    def appendList(self, rows):
        self.rows += rows

    def clear(self):
        self.rows = []

    def update(self, row):
        self.rows = [row]

    def registerTimer(self, at):
        self.timers.append(at)


def test_a_key_has_one_timer_for_the_rows_of_a_batch():
    """Every expired timer reads the waiting rows; one for each row made a long wait quadratic."""
    m = monitor.OrderedMonitor(10**9)
    m.results, m.samples, m.attempts, m.waiting, m.seen = Held(), Held(), Held(), Held(), Held()
    m.handle = Held()
    batch = pd.DataFrame({"seq": range(1000), "value": None, "event": "seen", "at_ms": [1000 + 10 * i for i in range(1000)]})
    list(m.handleInputRows(("t", "f"), iter([batch[::2], batch[1::2]]), None))
    assert m.handle.timers == [1000]
    now = types.SimpleNamespace(getCurrentWatermarkInMs=lambda: 5999)
    out = pd.concat(m.handleExpiredTimer(("t", "f"), now, None))
    assert out["seq"].tolist() == list(range(500)) and len(m.waiting.rows) == 500
    # the waiting rows have a timer, and the idle key has one
    assert sorted(m.handle.timers) == [1000, 6000, 5990 + 10**9]
