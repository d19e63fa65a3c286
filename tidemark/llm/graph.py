"""Connected components by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.support import cut_small, join_small


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): equal roots, same component.

    In each round every node goes over to the first node among itself and its neighbours, in an
    order drawn anew per round; edges between merged nodes vanish. A star vanishes in one round
    and the expected number of nodes falls by a constant factor in any graph, so rounds grow as the
    logarithm of the nodes. The rounds' maps are then composed backwards. The edges of a hub are
    dealt to shares, so no task gets all of them.
    """
    edges = cut_small(edges.where("a <> b").select("a", "b").distinct())
    maps: list[tuple[DataFrame, int]] = []
    while True:
        step = cut_small(_step(edges, len(maps)))
        nodes = step.count()
        if not nodes:
            break
        maps.append((step, nodes))
        for end, new in (("a", "x"), ("b", "y")):
            edges = join_small(edges, step.select(F.col("node").alias(end), F.col("to").alias(new)), end, nodes)
        edges = cut_small(edges.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    labels, size = maps[-1][0].select("node", F.col("to").alias("root")), maps[-1][1]
    for step, nodes in reversed(maps[:-1]):
        later = labels.select(F.col("node").alias("to"), F.col("root"))
        labels, size = join_small(step, later, "to", size, "left").select("node", F.coalesce("root", "to").alias("root")), nodes
    return labels


def _step(edges: DataFrame, turn: int) -> DataFrame:
    """(node, to): where each node goes."""
    order = lambda c: F.struct(F.xxhash64(F.lit(turn), F.col(c)).alias("h"), F.col(c).alias("n"))
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    best = both.groupBy("a").agg(F.min(order("b")).alias("m"))
    return best.select(F.col("a").alias("node"), F.least(order("a"), F.col("m"))["n"].alias("to"))
