"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skysense.llm.common import stored

ROUNDS = 60


def _least_neighbour(pairs: DataFrame) -> DataFrame:
    """``pairs`` (u, v) with ``m``, the least of u and its neighbours. A node with many links is
    aggregated before the shuffle, and joined back by a join that adaptive execution can split."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    return (_least_neighbour(both).filter((F.col("v") > F.col("u")) & (F.col("v") != F.col("m")))
            .select(F.col("v").alias("a"), F.col("m").alias("b")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    # Here every link goes from its larger node a to its smaller one b.
    down = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    known = _least_neighbour(down)
    moved = known.filter(F.col("v") != F.col("m")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    own = known.select(F.col("u").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(own).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Per node that is linked to a smaller one: ``node`` and ``component``, the least node it reaches.

    Links are pairs of whole numbers in any order; a node linked to itself only, and NULL
    links, don't count. Nodes that aren't in the result are the least of their component.
    """
    edges = stored(links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
                   .filter("a <> b").distinct(), "edges")
    for _ in range(ROUNDS):
        edges = stored(_small_star(_large_star(edges)), "edges")
        # Done when every node has one link down, to a node that has none.
        ends = edges.select(F.col("a").alias("u"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(
            edges.select(F.col("b").alias("u"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        open_nodes = ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 OR up = 1 AND down = 1")
        if open_nodes.isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    raise RuntimeError("components need more rounds")
