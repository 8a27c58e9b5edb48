"""Connected components of a distributed list of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seatwise.llm.common import written


def _star(edges: DataFrame) -> DataFrame:
    """Each node with the least of itself and its neighbours."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u"), F.least("u", "m").alias("m"))


def _has_two_ends(edges: DataFrame) -> bool:
    return not edges.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node`` and ``label`` (the least node reachable) of every node that a link joins to another; nodes are whole numbers.

    Every round sends each node's larger neighbours, then its smaller ones, to the least node it sees; it ends when no node that others
    point to points to another. Links stay distributed: a round is two group-bys and two joins and is written to the shared folder.
    A null end and a link of a node with itself say nothing and are left out.
    """
    ends = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull())
    edges = written(ends.where("u != v").distinct(), "links")
    while not edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty() or _has_two_ends(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        larger = both.where("v > u").join(_star(both), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = _star(larger)
        smaller = larger.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(smaller.unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct(), "links")
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return nodes.unionByName(nodes.select(F.col("label").alias("node"), "label").distinct())
