"""Connected components as a loop of DataFrame joins (alternating large-star and small-star steps).

Each step needs one minimum per node, which is pre-aggregated, and one join on the node. The minima are a written
table, so both sides of the join are plain exchanges and adaptive execution can split a node that has very many edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.llm._common import written


def _star(spark: SparkSession, pairs: DataFrame, only_larger: bool) -> DataFrame:
    """pairs (u, v): link each neighbour v to the least of u and its neighbours; in the large star only v > u."""
    least = written(spark, pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "least")
    linked = pairs.filter("v > u") if only_larger else pairs
    out = linked.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not only_larger:
        out = out.unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def _digest(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], int(row["h"] or 0)


def connected_components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """edges (src long, dst long), undirected; rows with a null end or equal ends link nothing.

    Returns (node, component) for every node that has an edge; component is the least node reachable. An empty table
    gives an empty table. The loop ends when a round changes no edge, after O(log^2 n) rounds at most.
    """
    canonical = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).filter("src is not null and dst is not null and u <> v")
    current = written(spark, canonical.distinct(), "edges")
    before = _digest(current)
    while before[0]:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = written(spark, _star(spark, both, True), "large")
        current = written(spark, _star(spark, large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), False), "small")
        now = _digest(current)
        if now == before:
            break
        before = now
    roots = current.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
