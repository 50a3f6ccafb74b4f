"""Connected components of an edge table, by alternating large-star and small-star rounds.

Each round is two joins and two grouped minima; only a count reaches the driver. Minima are pre-aggregated
before the shuffle and stored: a join of two shuffled tables, not of a table with a grouping, is what adaptive
execution can split where a hub node is a hot key. Rounds end when the edges are stars, which copies of one
leader are from the start.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import drop, store


def components(edges: DataFrame, a: str = "a", b: str = "b", most: int = 60) -> DataFrame:
    """(node, component) for every node that has an edge; component: the smallest node reachable."""
    e = (
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where("u <> v")
        .distinct()
    )
    e = store(e, "edges")
    for _ in range(most):
        if _stars(e):
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least(both)
        large = store(_large_star(both, least), "edges")
        drop(e, least)
        least = _least(large)
        e = store(_small_star(large, least), "edges")
        drop(large, least)
    else:
        raise RuntimeError("components: no fixed point")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _stars(e: DataFrame) -> bool:
    """Whether every node has one smaller neighbour at most, and none that has one is a smaller neighbour itself."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("above"), F.lit(0).alias("below")).union(e.select("v", F.lit(0), F.lit(1)))
    per = ends.groupBy("x").agg(F.sum("above").alias("above"), F.max("below").alias("below"))
    return per.where("above > 1 OR above = 1 AND below = 1").limit(1).count() == 0


def _least(e: DataFrame) -> DataFrame:
    """u, m: the least neighbour of every node with edges (u, v). Stored."""
    return store(e.groupBy("u").agg(F.min("v").alias("m")), "least")


def _large_star(both: DataFrame, least: DataFrame) -> DataFrame:
    """Larger neighbours are joined to the least of a node and its neighbours; an edge may come twice."""
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(e: DataFrame, least: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are joined to the least of these."""
    rest = e.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
