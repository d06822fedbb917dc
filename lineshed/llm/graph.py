"""Connected components of an edge table by alternating large and small stars.

Every round rewires each node's neighbours to its smallest neighbour; rounds are aggregates and
equi-joins, so a node with very many neighbours is pre-aggregated. The minima and the edges of each
round are written to the shared folder: this cuts the lineage, and leaves both sides of every join as
plain shuffles, which the adaptive planner can split where a node has very many neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineshed.session import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = materialize(down.groupBy("u").agg(F.min("v").alias("m")), "least")
    joined = down.join(least, "u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Rows (node, component) for every node with an edge to another; component is its least node."""
    edges = materialize(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u != v").distinct(), "edges")
    before = None
    while True:
        edges = materialize(_small_star(_large_star(edges)).distinct(), "edges")
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            break
        before = state
    roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
