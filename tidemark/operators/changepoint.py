"""Change points of a daily series by two-sided cumulative sums."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "bank string, day date, kind string, magnitude double, before double, after double"
#: Fixed values of the method.
DRIFT, SHORT, NARROW, WIDE, QUIET_DAYS, LEAST_ITEMS, LEAST_DAYS = 0.3, 15, 1.8, 2.0, 7, 8, 5


@dataclass
class Cusum:
    """The sums above and below, and what was found. Streams run it over the days that are closed."""

    drift: float
    limit: float
    above: float = 0.0
    below: float = 0.0
    found: list[tuple[date, float, float, float]] = field(default_factory=list)

    def add(self, gap: float) -> bool:
        self.above = max(0.0, self.above + gap - self.drift)
        self.below = min(0.0, self.below + gap + self.drift)
        return self.above > self.limit or self.below < -self.limit

    def report(self, day: date, size: float, before: float, after: float) -> None:
        """Of two within a week the larger stays; the sums restart only if this one does."""
        if self.found and (day - self.found[-1][0]).days < QUIET_DAYS:
            if size <= self.found[-1][1]:
                return
            self.found.pop()
        self.found.append((day, size, before, after))
        self.above = self.below = 0.0


def kind_of(size: float, before: float, after: float, spread: float) -> str:
    if size > 2.5 * spread:
        return "regime_shift"
    return "tone_reversal" if min(before, after) < -0.01 and max(before, after) > 0.01 else "guidance_change"


def change_points(days: list[date], mean: np.ndarray, count: np.ndarray) -> list[tuple[date, str, float, float, float]]:
    n = len(days)
    if n < LEAST_DAYS or count.sum() < LEAST_ITEMS:
        return []
    width = min(5, n // 3)
    sums, counts = np.cumsum(np.append(0.0, mean * count)), np.cumsum(np.append(0, count))
    low = np.maximum(0, np.arange(n) - width + 1)
    smooth = (sums[1:] - sums[low]) / (counts[1:] - counts[low])
    level, spread = smooth.mean(), smooth.std() or 0.03
    state = Cusum(DRIFT * spread, spread * (NARROW if n < SHORT else WIDE))
    for i in range(1, n):
        if state.add(smooth[i] - level):
            reach = min(i, max(3, n // 4))
            before, after = smooth[i - reach : i].mean(), smooth[i : i + min(n - i, reach)].mean()
            if (size := abs(after - before)) >= max(0.03, 0.5 * spread):
                state.report(days[i], size, before, after)
    third = lambda x: np.floor(x * 1000 + 0.5) / 1000
    return [(d, kind_of(s, b, a, spread), s, third(b), third(a)) for d, s, b, a in state.found]


def per_bank(items: DataFrame) -> DataFrame:
    """Spark sums the items of each day; only the days of a bank meet in one task."""
    daily = items.groupBy("bank", "item_date").agg(F.avg("net_score").alias("mean"), F.count("*").alias("n"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("item_date")
        found = change_points(list(frame["item_date"]), frame["mean"].to_numpy(), frame["n"].to_numpy())
        return pd.DataFrame([(frame["bank"].iloc[0], *x) for x in found], columns=["bank", "day", "kind", "magnitude", "before", "after"])

    return daily.groupBy("bank").applyInPandas(run, SCHEMA)
