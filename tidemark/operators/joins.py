"""Joins that Spark has no single operator for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(rows: DataFrame, marks: DataFrame, by: list[str], at: str, mark: str, values: list[str], strict: bool = False) -> DataFrame:
    """``rows`` with the values of the latest mark at or before ``at`` (before it, if ``strict``).

    Both sides are united and the last mark is carried forward: one sort per key, no pairs. Use it
    for many marks; few marks per key are better as intervals (see ``intervals``)."""
    side = F.lit(0 if strict else 1)
    named = {v: f"__{v}" for v in values}
    left = rows.withColumns({x: F.lit(None).cast(marks.schema[v].dataType) for v, x in named.items()}).withColumn("__t", F.col(at)).withColumn("__side", side).withColumn("__is", F.lit(True))
    right = marks.select(*by, F.col(mark).alias("__t"), *(F.col(v).alias(x) for v, x in named.items())).withColumn("__side", F.lit(1) - side).withColumn("__is", F.lit(False))
    order = Window.partitionBy(*by).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right, allowMissingColumns=True)
    last = F.last(F.when(~F.col("__is"), F.struct(*named.values())), ignorenulls=True).over(order)
    both = both.withColumn("__last", last).where("__is")
    return both.select(*rows.columns, *(F.col(f"__last.{x}").alias(v) for v, x in named.items()))


def intervals(marks: DataFrame, by: list[str], mark: str) -> DataFrame:
    """Marks with the one before and the one behind on the same key."""
    order = Window.partitionBy(*by).orderBy(mark)
    return marks.withColumn("previous", F.lag(mark).over(order)).withColumn("next", F.lead(mark).over(order))


#: Members of over 1 / FREQUENT of all rows are at most so many.
FREQUENT = 10_000


def with_frequency(members: DataFrame, column: str) -> DataFrame:
    """``members`` with ``df``, how many rows have the same value. Frequent values, FREQUENT at most, are
    broadcast, so no task gets all the rows of one."""
    counts = members.groupBy(column).agg(F.count("*").alias("df"))
    least = max(100, members.count() // FREQUENT)
    often = F.broadcast(counts.where(F.col("df") > least))
    return members.join(often, column).unionByName(members.join(often, column, "left_anti").join(counts.where(F.col("df") <= least), column))


def similar_sets(rows: DataFrame, id_column: str, set_column: str, threshold: float) -> DataFrame:
    """Pairs (a, b) of rows whose sets have a Jaccard similarity of ``threshold`` or more. Sets that
    similar share one of their rarest members: the first size - ceil(threshold * size) + 1. The first one that they share
    stands so early in both that what is behind it suffices, so only such places make candidates."""
    one = rows.where(F.size(set_column) > 0).select(F.col(id_column).alias("id"), F.col(set_column).alias("set"))
    members = one.select("id", F.size("set").alias("n"), F.explode("set").alias("x"))
    order = Window.partitionBy("id").orderBy("df", "x")
    ranked = with_frequency(members, "x").withColumn("rank", F.row_number().over(order))
    prefix = ranked.where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).select("id", "n", "x", "rank")
    other = prefix.select(F.col("id").alias("b"), F.col("n").alias("m"), F.col("rank").alias("place"), "x")
    sizes = F.least("n", "m") >= threshold * F.greatest("n", "m") - 1e-9
    left = 1 + F.least(F.col("n") - F.col("rank"), F.col("m") - F.col("place"))
    enough = left >= threshold / (1 + threshold) * (F.col("n") + F.col("m")) - 1e-9
    pairs = prefix.withColumnRenamed("id", "a").join(other, "x").where((F.col("a") < F.col("b")) & sizes & enough).select("a", "b").distinct()
    full = pairs.join(one.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a").join(one.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    return full.where(both >= threshold * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def without_similar(rows: DataFrame, other: DataFrame, by: list[str], id_column: str, day: str, words: str, days: int = 7, threshold: float = 0.8) -> DataFrame:
    """``rows`` but for those that ``other`` has on the same keys, within ``days``, with a set of words (an array) of
    Jaccard similarity ``threshold`` or more. Distinct sets are compared once, however many rows have them; then the
    days on which a key has a set, or one like it, are put in order, and a row needs the nearest on either side only."""
    own = rows.withColumn("__set", F.array_sort(F.array_distinct(words)))
    theirs = other.select(*by, F.col(day).alias("__day"), F.array_sort(F.array_distinct(words)).alias("__set")).where(F.size("__set") > 0).distinct()
    mine = own.select(*by, F.col(day).alias("__day"), "__set").where(F.size("__set") > 0).distinct()
    sets = mine.select("__set").unionByName(theirs.select("__set")).distinct()
    # a set stands for itself as an identifier, so two of one hash stay apart
    pairs = similar_sets(sets.withColumn("__id", F.col("__set")), "__id", "__set", threshold)
    alike = pairs.select(F.col("a").alias("__set"), F.col("b").alias("__to")).unionByName(pairs.select(F.col("b").alias("__set"), F.col("a").alias("__to"))).unionByName(sets.select("__set", F.col("__set").alias("__to")))
    there = theirs.join(alike, "__set").select(*by, "__day", F.col("__to").alias("__set")).distinct()
    both = mine.withColumn("__mine", F.lit(True)).unionByName(there.withColumn("__mine", F.lit(False)))
    order = Window.partitionBy(*by, "__set").orderBy(F.unix_date("__day")).rangeBetween(-days, days)
    gone = both.withColumn("__met", F.bool_or(~F.col("__mine")).over(order)).where("__mine AND __met").select(*by, F.col("__day").alias(day), "__set")
    return own.join(gone, [*by, day, "__set"], "left_anti").select(*rows.columns)
