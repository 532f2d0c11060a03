"""Connected components of a distributed edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import cut, hot_join, store


def _lowest(edges: DataFrame, total: int) -> DataFrame:
    """Each edge (a, b) with the smallest b of its a; the edges of a hub stay where they are.

    The join names its two tables several times, so the smallest ones are cut, and `edges` should be a stored table:
    else plans of steps multiply, and the driver holds each of their versions.
    """
    low = cut(edges.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("n")))
    return hot_join(edges, low, "a", "n", total).drop("n")


def _each(edges: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """Several edges (a, b) from each row, in one pass."""
    made = F.explode(F.array(*(F.struct(F.col(a).alias("a"), F.col(b).alias("b")) for a, b in pairs)))
    return edges.select(made.alias("edge")).select("edge.a", "edge.b")


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that has an edge; the component is its smallest node.

    `edges` has long columns a and b in any direction; loops, nulls and repeats are allowed. The edges of each step are
    stored: a checkpoint would pass on the planner's guess of a join's size, whose digits double with each step.
    Rounds grow with the logarithm of the number of nodes.
    """
    pairs = edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs = store(pairs)
    before = (0, None)  # no edges, nothing to do
    while (now := _state(pairs)) != before:
        before = now
        both = _each(pairs, ("a", "b"), ("b", "a"))
        large = _lowest(both, 2 * now[0]).filter("b > a").select(F.col("b").alias("a"), F.least("a", "low").alias("b"))
        small = _lowest(store(large.distinct()), 2 * now[0])
        pairs = store(_each(small, ("a", "low"), ("b", "low")).filter("a != b").distinct())
    members = pairs.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return members.unionByName(pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
