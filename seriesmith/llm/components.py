"""Connected components of a graph given by its edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesmith.llm.common import materialize

MAX_ROUNDS = 50


def _least_neighbours(edges: DataFrame) -> DataFrame:
    """u, least: the smallest of u and its neighbours, from edges in both directions; an exchange of its own keeps the later
    join splittable where a node has very many edges."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("least")).select((F.col("u") + F.lit(0)).alias("w"), "least")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least_neighbours(both)
    return both.filter("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("least").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """edges: u > v."""
    least = _least_neighbours(edges)
    down = edges.join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("least").alias("v"))
    return down.union(least.select(F.col("w").alias("u"), F.col("least").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """node, root (the component's smallest node) for every node of edges (u, v: long). A round needs four shuffles of the
    edges, whose number never grows; rounds are about the logarithm of the longest path."""
    ends = F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    edges = materialize(edges.select(*ends).filter("u != v").distinct(), "edges")
    before = None
    for _ in range(MAX_ROUNDS):
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before or now[0] == 0:
            break
        before = now
        stars = _small_star(_large_star(edges).filter("u > v").distinct())
        edges = materialize(stars.filter("u > v").distinct(), "edges")
    else:
        raise RuntimeError(f"components didn't settle in {MAX_ROUNDS} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v")).distinct()
