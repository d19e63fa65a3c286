"""Threshold alerts over metrics, and their cooldown in event time."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def evaluate(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules (id, metric, op, t) that fire on metrics (metric, v, ...). ``eq`` means within 0.01."""
    v, t, op = F.col("v"), F.col("t"), F.col("op")
    fires = F.when(op == "gt", v > t).when(op == "lt", v < t).when(op == "gte", v >= t).when(op == "lte", v <= t).when(op == "eq", F.abs(v - t) < 0.01).otherwise(False)
    return metrics.join(rules, "metric").where(fires)


@dataclass
class Rest:
    """Of one rule: the microsecond of its last alert. The rows must come in order of time."""

    micros: int
    last: int | None = None

    def fires(self, at: int) -> bool:
        if self.last is not None and at - self.last < self.micros:
            return False
        self.last = at
        return True


def cooled(crossings: DataFrame, minutes: int, *order: str) -> DataFrame:
    """Of the rows (key, ts, ...) that are over their thresholds those that raise an alert: the first of a key, and each that
    comes ``minutes`` or more after the alert before it. Rows of one moment are ordered by ``order``. Null times never fire.

    A row behind a pause of ``minutes`` fires whatever was before, so rows between two such pauses are a run of
    their own, and runs, not keys, are what is dealt to tasks. A run passes through its task in Arrow batches with
    one number of state, so its length takes no memory."""
    micros = minutes * 60_000_000
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    turn = Window.partitionBy("key").orderBy("__at", *order)
    rows = crossings.withColumn("__at", at).where("__at IS NOT NULL").withColumn("__gap", F.col("__at") - F.lag("__at").over(turn))
    rows = rows.withColumn("__run", F.count_if(F.coalesce(F.col("__gap") >= micros, F.lit(True))).over(turn))
    alone = F.coalesce(F.col("__gap") >= micros, F.lit(True)) & F.coalesce(F.lead("__gap").over(turn) >= micros, F.lit(True))
    rows = rows.withColumn("__alone", alone)
    wide = rows.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rest = None, Rest(micros)
        for batch in batches:
            keys, runs, times = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("key", "__run", "__at"))
            fired = np.zeros(batch.num_rows, dtype=bool)
            for i, now in enumerate(zip(keys, runs)):
                if now != held:
                    held, rest = now, Rest(micros)
                fired[i] = rest.fires(times[i])
            yield batch.filter(pa.array(fired))

    long = rows.where(~F.col("__alone")).repartition("key", "__run").sortWithinPartitions("key", "__run", "__at", *order)
    found = long.mapInArrow(run, wide).unionByName(rows.where("__alone"))
    return found.select(*crossings.columns)
