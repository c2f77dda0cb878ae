"""Connected components of an edge table, by alternating star contraction.

Every round rewires each node to the smallest node it knows (first its larger neighbours, then its smaller ones), until
all components are stars. Rounds are joins and minima only: no node's neighbours are ever gathered, so a hub costs a
skewed join side that adaptive execution splits. Each round is written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillfund.llm.common import written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every node with an edge to another node; ``component`` is the smallest reachable node.

    Self-loops, repeated edges and edges with a null end are ignored; an empty edge table gives an empty result.
    """
    edge = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edge = written(edge, "edges")
    while not _stars(edge):
        both = edge.unionByName(edge.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        edge = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = edge.groupBy("u").agg(F.min("v").alias("m"))
        edge = edge.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()
        edge = written(edge, "edges")
    return edge.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edge.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _stars(edge: DataFrame) -> bool:
    """True if every node has one edge to a smaller node and no centre has any."""
    rows, tops = edge.agg(F.count(F.lit(1)), F.countDistinct("u")).first()
    return rows == tops and edge.join(edge.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty()
