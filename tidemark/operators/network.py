"""Who sounds like whom: similarity of means, as edges and as sums per node."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Similarity falls by 5 per unit of distance, and an edge has more than 0.3.
SLOPE, LEAST = 5, 0.3
#: Means are compared in billionths; the largest distance of an edge, and the width of the bands.
UNIT = 10**9
FAR = round((1 - LEAST) / SLOPE * UNIT) - 1
BAND = FAR + 1


def banded(nodes: DataFrame) -> DataFrame:
    units = F.round(F.col("mean") * UNIT).cast("long")
    return nodes.withColumn("__u", units).withColumn("__band", F.floor(F.col("__u") / BAND))


def edges(nodes: DataFrame) -> DataFrame:
    """(a, b, similarity) of nodes (name, mean) that are near: each meets its own band and the next ones, never all."""
    left = banded(nodes.select(F.col("name").alias("a"), "mean")).select("a", F.col("__u").alias("u"), "__band")
    right = banded(nodes.select(F.col("name").alias("b"), "mean")).select("b", F.col("__u").alias("v"), F.explode(F.array(F.col("__band") - 1, F.col("__band"), F.col("__band") + 1)).alias("__band"))
    near = left.join(right, "__band").where((F.col("a") < F.col("b")) & (F.abs(F.col("u") - F.col("v")) <= FAR))
    return near.select("a", "b", (1 - SLOPE * F.abs(F.col("u") - F.col("v")) / UNIT).alias("similarity"))


#: Sums are of means in units of this many to one, as decimals: their error is that of a double.
FINE = 10**15


def nodes_with_sums(nodes: DataFrame, doubles: bool = False) -> DataFrame:
    """``nodes`` (name, mean, ..) with degree (how many edges) and strength (the sum of their similarities), without an edge being made: a
    node's neighbours are a range of the sorted means of its band and the two next to it, and sums of similarities are differences of running counts and
    sums, so a band takes one pass. With ``doubles`` nodes have an edge where 1 - SLOPE * abs(a - b) > LEAST holds for the means as doubles: what lies within
    a billionth of the bound is left out of the range and tested by itself, by distinct means."""
    reach = FAR - 1 if doubles else FAR
    rows = banded(nodes).withColumn("__x", F.round(F.col("mean").cast("decimal(38,18)") * FINE).cast("decimal(18,0)"))
    sent = rows.withColumn("__to", F.explode(F.array(F.col("__band") - 1, F.col("__band"), F.col("__band") + 1)))
    upto = lambda d: Window.partitionBy("__to").orderBy("__u").rangeBetween(Window.unboundedPreceding, d)
    ends = {"below": -reach - 1, "own": 0, "above": reach}
    met = sent.withColumns({f"__n_{e}": F.count("*").over(upto(d)) for e, d in ends.items()} | {f"__s_{e}": F.coalesce(F.sum("__x").over(upto(d)), F.lit(0)) for e, d in ends.items()})
    n = lambda a, b: F.col(f"__n_{a}") - F.col(f"__n_{b}")
    total = lambda a, b: F.col(f"__s_{a}") - F.col(f"__s_{b}")
    # a node is among those below itself, at distance 0, as are equal means
    apart = F.col("__x") * (n("own", "below") - n("above", "own")).cast("decimal(15,0)") - total("own", "below") + total("above", "own")
    degree = n("above", "below") - 1
    own = met.where("__to = __band").withColumns({"degree": degree, "strength": degree - SLOPE * (apart.cast("double") / FINE)})
    own = own.select(*nodes.columns, "degree", "strength")
    if not doubles:
        return own
    more = _at_the_bound(nodes)
    return own.join(more, "mean", "left").select(*nodes.columns, (F.col("degree") + F.coalesce("__degree", F.lit(0))).alias("degree"), (F.col("strength") + F.coalesce("__strength", F.lit(0.0))).alias("strength"))


def _at_the_bound(nodes: DataFrame) -> DataFrame:
    """(mean, __degree, __strength): edges of each distinct mean with those whose distance is the bound to a billionth."""
    means = banded(nodes.groupBy("mean").agg(F.count("*").alias("n"))).select("mean", "n", "__u")
    far = [sign * (FAR + d) for sign in (-1, 1) for d in (0, 1, 2)]
    asked = means.select(F.col("mean").alias("own"), F.explode(F.array(*(F.col("__u") + d for d in far))).alias("__u"))
    alike = 1 - SLOPE * F.abs(F.col("own") - F.col("mean"))
    met = asked.join(means, "__u").withColumn("alike", alike).where(F.col("alike") > LEAST)
    return met.groupBy(F.col("own").alias("mean")).agg(F.sum("n").alias("__degree"), F.sum(F.col("n") * F.col("alike")).alias("__strength"))
