"""Alerts of a stream with a cooldown per rule, in event time.

Rows over their threshold wait in the state of their rule until the watermark has passed them; then they are
judged in order of time. So alerts depend neither on the order in which rows arrive nor on how they fall into
batches, and equal those of ``operators.alerts.cooled`` over the same rows; rows behind the watermark are dropped by
Spark. Event time has timers, not time to live: one timer a rule wakes at its earliest waiting row, and, when the
cooldown is over and nothing waits, clears the state, so a quiet rule costs nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.alerts import Rest

OUT = "key string, ts timestamp, v double"


class Cooldown(StatefulProcessor):
    """Keyed by rule. ``waiting`` (at, v): rows the watermark hasn't passed; ``last``: the last alert; ``alarm``: the timer set."""

    def __init__(self, minutes: int) -> None:
        self.micros = minutes * 60_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, v double")
        self.last = handle.getValueState("last", "at long")
        self.alarm = handle.getValueState("alarm", "at long")

    def wake(self, millis: int | None) -> None:
        """At most one timer a rule, the earliest needed."""
        have = self.alarm.get()[0] if self.alarm.exists() else None
        if have == millis:
            return
        if have is not None:
            self.handle.deleteTimer(have)
            self.alarm.clear()
        if millis is not None:
            self.handle.registerTimer(millis)
            self.alarm.update((millis,))

    def settle(self, key: tuple, passed: int) -> pd.DataFrame:
        """Judge what lies behind the watermark of ``passed`` microseconds, keep the rest."""
        rest = Rest(self.micros, self.last.get()[0] if self.last.exists() else None)
        rows = sorted((r[0], r[1]) for r in self.waiting.get()) if self.waiting.exists() else []
        done = [r for r in rows if r[0] < passed]
        fired = [(key[0], pd.Timestamp(at, unit="us"), v) for at, v in done if rest.fires(at)]
        # what the cooldown already covers will never fire
        left = [r for r in rows[len(done) :] if rest.last is None or r[0] - rest.last >= self.micros]
        if left:
            self.waiting.put(left)
        else:
            self.waiting.clear()
        over = None if rest.last is None else rest.last + self.micros
        if over is not None and over <= passed:
            self.last.clear()
            over = None
        elif rest.last is not None:
            self.last.update((rest.last,))
        due = min([at for at, _ in left] + ([over] if over is not None else []), default=None)
        self.wake(None if due is None else due // 1000 + 1)
        return pd.DataFrame(fired, columns=["key", "ts", "v"])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            found = [(int(at), float(v)) for at, v in zip(frame["at"], frame["v"])]
            if found:
                self.waiting.appendList(found)
        yield self.settle(key, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.alarm.clear()
        yield self.settle(key, timerValues.getCurrentWatermarkInMs() * 1000)

    def close(self) -> None:
        pass


def with_cooldown(metrics: DataFrame, threshold: float, minutes: int = 60, late: str = "1 day") -> DataFrame:
    """Alerts (key, ts, v) of a stream (key, ts, v): values over ``threshold``, one per key and ``minutes`` at most. Needs the RocksDB state store."""
    over = metrics.where((F.col("v") > threshold) & F.col("ts").isNotNull()).select(F.col("key").cast("string").alias("key"), "ts", "v").withWatermark("ts", late)
    rows = over.withColumn("at", F.unix_micros("ts"))
    return rows.groupBy("key").transformWithStateInPandas(statefulProcessor=Cooldown(minutes), outputStructType=OUT, outputMode="Append", timeMode="EventTime")
