"""Connected components of a link table, by alternating large-star and small-star steps.

Links stay a table from step to step: each step is an aggregation of the smallest neighbour and a join, and is
written to the shared folder. The number of steps grows with the logarithm of the longest chain. A vertex with
very many links is one row after the partial aggregation; the join spreads it as a skewed key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import stage


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour is linked to the smallest of a vertex and its neighbours."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Every smaller neighbour, and the vertex, are linked to the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    others = down.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return others.union(least.select("a", F.col("m").alias("b")))


def _single(links: DataFrame) -> bool:
    return links.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """id, component_id (smallest id reachable) of every vertex that has a link; from rows (a, b), a != b."""
    links = stage(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "links")
    # done when every vertex has one link, to a vertex that has none itself
    while not (_single(links) and links.join(links.select(F.col("b").alias("a")), "a", "left_semi").isEmpty()):
        links = stage(_small_star(_large_star(links)).distinct(), "links")
    roots = links.select(F.col("b").alias("id")).distinct()
    return links.select(F.col("a").alias("id"), F.col("b").alias("component_id")).union(
        roots.select("id", F.col("id").alias("component_id")))
