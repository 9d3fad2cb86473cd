"""Connected components of a link table by alternating large-star and small-star rounds.

A round is two group-by minima and joins on keys; a vertex's neighbours are never gathered. Every round is written to
the shared staging folder, so lineage stays short, and so are the minima, so that
Spark can split the join of a vertex with very many neighbours. The number of rounds grows with the logarithm of the vertices.
"""

from pyspark.sql import DataFrame, functions as F

from recollect.llm.frames import stage_narrow


def _settled(edges: DataFrame) -> bool:
    """Whether every vertex has one smaller neighbour at most, and none that has a smaller one itself."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(
        edges.select(F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("in")))
    seen = ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("in").alias("in"))
    return seen.where("out > 1 OR (out = 1 AND in = 1)").isEmpty()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(vertex, root): every vertex that has a link, with the least vertex reachable from it."""
    pairs = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    edges = stage_narrow(pairs.distinct(), "links")
    while not _settled(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        least = stage_narrow(least, "least-neighbours")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stage_narrow(large, "large-star")
        low = stage_narrow(large.groupBy("u").agg(F.min("v").alias("m")), "least-neighbours")
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stage_narrow(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "small-star")
    roots = edges.select(F.col("u").alias("vertex"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("vertex"), "root").distinct())
