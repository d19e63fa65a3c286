"""Writing: upserts by key, appends, CSV, deletes and updates by predicate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(stored: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """One row per key, the last by ``order``; rows of ``new`` win ties."""
    both = stored.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in key]
    best = F.max(F.struct(F.col(order).alias("__o"), F.col("__new").alias("__n"), *[F.col(c) for c in rest if c != "__new"])).alias("b")
    return both.groupBy(*key).agg(best).select(*key, *[F.col(f"b.{c}") for c in rest if c != "__new"])


def latest(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("b")).select(*key, "b.*")


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def csv(rows: DataFrame, path: str) -> None:
    """Fields are quoted only where they must be; null is empty."""
    rows.write.mode("overwrite").option("header", True).option("escape", '"').option("nullValue", "").option("emptyValue", "").csv(path)


def delete_where(rows: DataFrame, cond: Column) -> DataFrame:
    """Rows for which the condition is unknown stay."""
    return rows.where(~F.coalesce(cond, F.lit(False)))


def update_where(rows: DataFrame, cond: Column, values: dict[str, Column]) -> DataFrame:
    hit = F.coalesce(cond, F.lit(False))
    return rows.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})
