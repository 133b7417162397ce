"""Extraction health as a stream: the flags of ``health``, kept incrementally.

``monitor_stream`` takes rows in order of arrival. ``monitor_ordered`` puts rows
of a key back in order: a row waits in the state until the watermark has passed
its time. It can start from the state a batch table left, and forgets idle keys.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import (
    ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues,
)

from webcorpus.operators.health import (
    KEEP_RESULTS, KEEP_SAMPLES, KEY, MAX_ATTEMPTS, MAX_NULL_SHARE, MIN_SEEN, RECENT, TRAILING_NULLS, health_window,
)
from webcorpus.session import cut_lineage

# workers get this module's code with the task and need no installed package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = (
    "template_id STRING, field STRING, seq BIGINT, value STRING, flagged BOOLEAN, "
    "can_heal BOOLEAN, attempts INT, n_samples INT"
)


def is_failing(results: list[str | None]) -> bool:
    if len(results) < MIN_SEEN:
        return False
    if all(v is None for v in results[-TRAILING_NULLS:]):
        return True
    recent = results[-RECENT:]
    return sum(v is None for v in recent) / len(recent) > MAX_NULL_SHARE


class FieldMonitor(StatefulProcessor):
    """Last results, last samples and repair attempts of one (template, field).

    A row with ``event`` = 'attempt' counts a failed repair, 'healed' clears the
    results and the counter but keeps the samples; other rows are observations.
    """

    NAMES = ["template_id", "field", "seq", "value", "flagged", "can_heal", "attempts", "n_samples"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.results = handle.getListState("results", "value STRING")
        self.samples = handle.getListState("samples", "value STRING")
        self.attempts = handle.getValueState("attempts", "n INT")

    def step(self, key: tuple, batch: pd.DataFrame) -> pd.DataFrame:
        """One flagged row for each observation of ``batch``, in order of seq."""
        results = [r[0] for r in self.results.get()]
        samples = [r[0] for r in self.samples.get()]
        attempts = self.attempts.get()[0] if self.attempts.exists() else 0
        batch = batch.sort_values("seq")
        out = []
        for seq, value, event in zip(batch["seq"], batch["value"], batch["event"]):
            if event == "attempt":
                attempts += 1
                continue
            if event == "healed":
                results, attempts = [], 0
                continue
            value = None if pd.isna(value) else value
            results = (results + [value])[-KEEP_RESULTS:]
            if value is not None:
                samples = (samples + [value])[-KEEP_SAMPLES:]
            out.append((key[0], key[1], seq, value, is_failing(results), attempts < MAX_ATTEMPTS, attempts, len(samples)))
        self.keep(results, samples, attempts)
        return pd.DataFrame(out, columns=self.NAMES)

    def keep(self, results: list[str | None], samples: list[str], attempts: int) -> None:
        for state, values in ((self.results, results), (self.samples, samples)):
            if values:
                state.put([(v,) for v in values])
            else:
                state.clear()
        self.attempts.update((attempts,))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        # the rows of one batch and key arrive in any order
        yield self.step(key, pd.concat(list(rows)))

    def close(self) -> None:
        pass


class OrderedMonitor(FieldMonitor):
    """A monitor whose rows wait for the watermark, and whose state goes when a key is idle.

    Every expired timer reads the waiting rows, so a key has one timer for the rows of
    a batch, not one for each. A 'tick' row only moves the watermark. ``idle_ms`` after the last row of a
    key its results, samples and attempts are cleared.
    """

    def __init__(self, idle_ms: int) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.handle = handle
        self.waiting = handle.getListState("waiting", "seq BIGINT, value STRING, event STRING, at BIGINT")
        self.seen = handle.getValueState("seen", "at BIGINT")

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: TimerValues) -> None:
        row = initialState.iloc[0]
        self.keep([None if pd.isna(v) else v for v in row["results"]], list(row["samples"]), int(row["attempts"]))
        self._touch(int(row["at_ms"]))

    def _touch(self, at: int) -> None:
        """Remember the time of the latest row and when the key will be idle."""
        self.seen.update((at,))
        self.handle.registerTimer(at + self.idle_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows))
        batch = batch[batch["event"] != "tick"]
        if len(batch):
            values = [None if pd.isna(v) else v for v in batch["value"]]
            # tuples are typed by position: seq, value, event, at
            self.waiting.appendList(list(zip(batch["seq"].tolist(), values, batch["event"].tolist(), batch["at_ms"].tolist())))
            # one timer for all rows of the batch: when it expires, the rows that still wait get the next one
            self.handle.registerTimer(int(batch["at_ms"].min()))
        yield pd.DataFrame([], columns=self.NAMES)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held = [tuple(r) for r in self.waiting.get()]
        due = [r for r in held if r[3] <= now]
        seen = self.seen.get()[0] if self.seen.exists() else None
        # the key was idle if nothing came up to its next row, or up to now
        if seen is not None and seen + self.idle_ms <= min([r[3] for r in due], default=now):
            for state in (self.results, self.samples, self.attempts, self.seen):
                state.clear()
        if not due:
            yield pd.DataFrame([], columns=self.NAMES)
            return
        later = [r for r in held if r[3] > now]
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(min(r[3] for r in later))
        else:
            self.waiting.clear()
        self._touch(max(r[3] for r in due))
        yield self.step(key, pd.DataFrame([r[:3] for r in due], columns=["seq", "value", "event"]))


def monitor_stream(observations: DataFrame) -> DataFrame:
    """Observations (template_id, field, seq, value, event) to one flagged row each, in order of arrival.

    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    return observations.groupBy("template_id", "field").transformWithStateInPandas(
        statefulProcessor=FieldMonitor(), outputStructType=OUTPUT, outputMode="Append", timeMode="None"
    )


def batch_state(history: DataFrame, attempts: DataFrame | None = None) -> DataFrame:
    """What a monitor would hold after ``history`` (template_id, field, seq, value, at): its initial state.

    ``attempts`` (template_id, field, attempts) counts failed repairs, 0 where it has no row.
    """
    last = health_window(history).groupBy(*KEY).agg(F.max_by(F.struct("results", "samples"), "seq").alias("w"))
    times = history.groupBy(*KEY).agg(F.unix_millis(F.max("at")).alias("at_ms"))
    state = last.join(times, KEY).select(*KEY, "w.results", "w.samples", "at_ms")
    if attempts is None:
        return state.withColumn("attempts", F.lit(0))
    return state.join(attempts.select(*KEY, "attempts"), KEY, "left").withColumn("attempts", F.coalesce("attempts", F.lit(0)))


def monitor_ordered(
    observations: DataFrame, delay: str = "10 minutes", idle_ms: int = 7 * 86_400_000, initial: DataFrame | None = None
) -> DataFrame:
    """Observations (template_id, field, seq, value, event, at) to one flagged row each, in order of seq within a key.

    A row may come up to ``delay`` late; what comes later is dropped. Rows are given
    out once the watermark has passed them, so the stream equals the batch flags
    whatever the order of arrival. seq must not fall while ``at`` rises. ``initial``
    is a ``batch_state``; later observations carry on from it. Needs the RocksDB state store.
    """
    timed = observations.select(*KEY, "seq", "value", "event", "at", F.unix_millis("at").alias("at_ms")).withWatermark("at", delay)
    return timed.groupBy(*KEY).transformWithStateInPandas(
        statefulProcessor=OrderedMonitor(idle_ms), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime",
        # its plan travels with the tasks, so it is written out, which also computes it once
        initialState=None if initial is None else cut_lineage(initial).groupBy(*KEY),
    )


def alerts(flags: DataFrame) -> DataFrame:
    return flags.filter("flagged")
