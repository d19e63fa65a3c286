"""How a narrative moves."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Points towards a pivot, of a change of sign between halves; of a shift, a slope beyond two bounds; of many items.
SIGN, SHIFT, SLOPE, MANY = 0.4, ((0.2, 0.3), (0.1, 0.15)), ((0.05, 0.2), (0.02, 0.1)), (10, 0.1)


def narrative(items: DataFrame, group: list[str], score: str, order: list[str]) -> DataFrame:
    """Per group: n, the mean of the latest five scores, the slope over their numbers and the points towards a pivot (both null under
    three items). All are sums over numbered rows: one sort per group."""
    by = Window.partitionBy(*group).orderBy(*order)
    rows = items.select(*group, F.col(score).alias("s"), F.row_number().over(by).alias("rn"), F.avg(score).over(by.rowsBetween(-4, 0)).alias("mean"), F.count("*").over(Window.partitionBy(*group)).alias("n"))
    part = lambda f, cond: f(F.when(cond, F.col("s")))
    half, early = F.col("rn") <= F.floor(F.col("n") / 2), F.col("rn") <= F.col("n") - 3
    got = rows.groupBy(*group, "n").agg(
        F.max_by("mean", "rn").alias("latest"), F.regr_slope("s", F.col("rn") - 1).alias("slope"), part(F.avg, half).alias("a"), part(F.avg, ~half).alias("b"),
        (part(F.sum, ~early) / 3 - F.coalesce(part(F.sum, early), F.lit(0.0)) / F.greatest(F.lit(1), F.first("n") - 3)).alias("shift"),
    )
    steps = lambda c, bounds: F.when(F.abs(c) > bounds[0][0], bounds[0][1]).when(F.abs(c) > bounds[1][0], bounds[1][1]).otherwise(0.0)
    points = F.when(F.col("a") * F.col("b") < 0, SIGN).otherwise(0.0) + steps(F.col("shift"), SHIFT) + steps(F.col("slope"), SLOPE) + F.when(F.col("n") > MANY[0], MANY[1]).otherwise(0.0)
    enough = F.col("n") >= 3
    return got.select(*group, "n", "latest", F.when(enough, F.col("slope")).alias("slope"), F.when(enough, F.round(F.least(F.lit(1.0), points), 2)).alias("pivot"))
