"""Small regressions from sums: nothing but sums leaves the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ols_two(rows: DataFrame, group: list[str], y: str, x: str, z: str) -> DataFrame:
    """Least squares of ``y`` on a constant, ``x`` and ``z`` per group: (group.., n, constant, b_x, b_z, error, r2). ``error`` is
    the standard error of the residuals. Groups whose predictors are on one line have no coefficients."""
    c = lambda a, b: F.covar_pop(F.col(a).cast("double"), F.col(b).cast("double"))
    sums = {"xx": c(x, x), "zz": c(z, z), "xz": c(x, z), "xy": c(x, y), "zy": c(z, y), "yy": c(y, y), "mx": F.avg(x), "mz": F.avg(z), "my": F.avg(y)}
    s = rows.groupBy(*group).agg(F.count("*").alias("n"), *(f.alias(k) for k, f in sums.items()))
    det = F.expr("xx * zz - xz * xz")
    over = lambda e: F.when(F.abs(det) > 1e-12, F.expr(e) / det)
    s = s.withColumn("b_x", over("xy * zz - zy * xz")).withColumn("b_z", over("zy * xx - xy * xz"))
    rest = F.expr("yy - b_x * xy - b_z * zy")  # mean square of the residuals
    error = F.when(F.col("n") > 3, F.sqrt(F.greatest(rest, F.lit(0.0)) * F.col("n") / (F.col("n") - 3)))
    return s.select(*group, "n", F.expr("my - b_x * mx - b_z * mz").alias("constant"), "b_x", "b_z", error.alias("error"), F.when(F.col("yy") > 0, 1 - rest / F.col("yy")).alias("r2"))


def two_regimes(rows: DataFrame, y: str, x: str, z: str, bound: float, least: int = 12) -> DataFrame:
    """ols_two() of the rows with ``y`` at ``bound`` or more (of all, if these are fewer than ``least``), as regime "normal", and
    of those below as regime "low"."""
    few = rows.agg((F.count_if(F.col(y) >= bound) < least).alias("few"))  # one row
    told = rows.join(F.broadcast(few))
    low: Column = F.col(y) < bound
    regime = F.explode(F.array_compact(F.array(F.when(~low | F.col("few"), "normal"), F.when(low, "low"))))
    return ols_two(told.withColumn("regime", regime), ["regime"], y, x, z)
