"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al., 2014).

Every step is a grouped minimum (combined before the shuffle) and a join on the node, so that no node's neighbours
are gathered anywhere; each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglens.llm.common import remove, written


def _with_least(e: DataFrame, least: DataFrame) -> DataFrame:
    """Edges with their node's least neighbour, a table by now: both sides of the join come straight from a shuffle, so that adaptive execution splits a node with very many edges."""
    return e.join(least, "u")


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    out = written(_with_least(both, least).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
    remove(least)
    return out


def _small_star(e: DataFrame) -> DataFrame:
    least = written(e.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = _with_least(e, least).filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    out = written(moved.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
    remove(least)
    return out


def components(edges: DataFrame) -> DataFrame:
    """``u``, ``v``: for every node with a link but the least of its component, that least node.

    ``edges`` has two columns of one orderable type; loops and repeated or reversed edges do no harm.
    """
    a, b = edges.columns
    e = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct(), "edges")
    while True:
        # Done when every node that has an edge has one, and its end has none: stars.
        many = e.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()
        if many and e.select("v").distinct().join(e.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            return e
        half = _large_star(e)
        remove(e)
        e = _small_star(half)
        remove(half)
