"""Edge lists: canonical form, nodes and degrees.

Graphs are undirected and simple: ``canonical`` orders every edge as (src < dst), drops self loops
and duplicates. Node ids may be any orderable type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def canonical(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """N1 input: (src < dst), no self loops, no duplicates."""
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    return (e.filter(F.col("a") != F.col("b"))
             .select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct())


def both_directions(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def nodes(edges: DataFrame) -> DataFrame:
    return both_directions(edges).select(F.col("src").alias("node")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """Degree per node (partial aggregate over both endpoints)."""
    return both_directions(edges).groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"))
