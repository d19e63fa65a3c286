"""Change points of a stream of scored items, day by day behind the watermark.

The state of a bank is one sum and one count a day. A day is closed when the watermark has passed its end, and days close
in order, whatever order items come in. When a day closes, the detector of the batch (``operators.changepoint.change_points``
over its ``Cusum``) runs over the closed days, since limits and levels are those of the whole series; what it finds is
given out if it differs from what was given out before. So after the last day the newest rows of
a bank are those of ``changepoint.per_bank`` over the same items. A bank's state and the work of a step grow with its days, not with its items.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.changepoint import change_points

OUT = "bank string, as_of date, day date, kind string, magnitude double, before double, after double"
DAY_MS = 86_400_000
EPOCH = dt.date(1970, 1, 1)


class Changes(StatefulProcessor):
    """Keyed by bank. ``days``: day number to (sum, count); ``closed``: the first day that isn't closed, and a digest of what was given out."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.days = handle.getMapState("days", "day int", "total double, n long")
        self.closed = handle.getValueState("closed", "before int, shown string")
        self.alarm = handle.getValueState("alarm", "at long")

    def step(self, key: tuple, watermark: int) -> Iterator[pd.DataFrame]:
        first_open = max(0, watermark) // DAY_MS
        before, shown = self.closed.get() if self.closed.exists() else (0, "")
        rows = sorted((k[0], v[0], v[1]) for k, v in self.days.iterator())
        done = [r for r in rows if r[0] < first_open]
        coming = [r[0] for r in rows if r[0] >= first_open]
        if coming:  # wake when the next day with items closes
            at = (coming[0] + 1) * DAY_MS
            if not self.alarm.exists() or self.alarm.get()[0] != at:
                if self.alarm.exists():
                    self.handle.deleteTimer(self.alarm.get()[0])
                self.handle.registerTimer(at)
                self.alarm.update((at,))
        if not done or done[-1][0] < before:
            return
        names = [EPOCH + dt.timedelta(days=r[0]) for r in done]
        total, n = np.array([r[1] for r in done]), np.array([r[2] for r in done])
        found = change_points(names, total / n, n)
        digest = blake2b(repr(found).encode(), digest_size=8).hexdigest()
        self.closed.update((done[-1][0] + 1, digest))
        if digest != shown and (found or shown):
            what = found or [(None, None, None, None, None)]  # a row without a day: what was found before no longer holds
            yield pd.DataFrame([(key[0], names[-1], *x) for x in what], columns=["bank", "as_of", "day", "kind", "magnitude", "before", "after"])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for day, part in frame.groupby("day")["score"]:
                have = self.days.getValue((int(day),)) if self.days.containsKey((int(day),)) else (0.0, 0)
                self.days.updateValue((int(day),), (have[0] + float(part.sum()), have[1] + len(part)))
        yield from self.step(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.alarm.clear()
        yield from self.step(key, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def change_stream(items: DataFrame, late: str = "1 day") -> DataFrame:
    """A stream of items (bank, ts, net_score): (bank, as_of, day, kind, magnitude, before, after), all change points of a bank as of the
    closed day ``as_of`` whenever they change; a row without a day says that there are none now. Items without a score, of one within
    0.001 of 0 or without a time don't count. Needs the RocksDB state store."""
    rows = items.where("abs(net_score) > 0.001 AND ts IS NOT NULL").select(F.col("bank").cast("string").alias("bank"), "ts", F.col("net_score").cast("double").alias("score"))
    rows = rows.withWatermark("ts", late).withColumn("day", F.unix_date(F.to_date("ts")))
    return rows.groupBy("bank").transformWithStateInPandas(statefulProcessor=Changes(), outputStructType=OUT, outputMode="Append", timeMode="EventTime")


def newest(found: DataFrame) -> DataFrame:
    """What holds now, of all that change_stream() gave out."""
    last = F.max("as_of").over(Window.partitionBy("bank"))
    return found.withColumn("__last", last).where("as_of = __last AND day IS NOT NULL").select("bank", "day", "kind", "magnitude", "before", "after")
