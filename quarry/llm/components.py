"""Connected components of an edge table, to convergence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import materialize


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """One round: join each node's (larger, or smaller-or-own) neighbours to the smallest of its
    neighbourhood. The smallest is a partial aggregate, so a hub is never gathered in one task;
    the join back is a plain equi-join that Spark may split."""
    adj = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    adj = adj.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    if not larger:
        adj = adj.filter("v < u")
    low = adj.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m"))
    if larger:
        out = adj.filter("v > u").join(low, "u").select(F.col("v").alias("x"), F.col("m").alias("y"))
    else:
        out = adj.join(low, "u").select(F.col("v").alias("x"), F.col("m").alias("y")) \
            .unionByName(low.select(F.col("u").alias("x"), F.col("m").alias("y")))
    return out.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def connected_components(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(node, label) for every node with an edge; label is the component's smallest node.

    Alternating large-star and small-star rounds (Kiveris et al., 2014), each written to the
    shared folder, until two rounds give the same edges. Only a count and a checksum of the edges
    reach the driver. Edges with a null end and loops are left out; no edges give no rows."""
    def mark(e: DataFrame) -> tuple:
        r = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        return r.n, r.h

    cur = materialize(edges.select(F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b"))
                      .filter(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst)))
                      .distinct(), "components")
    before = mark(cur)
    while before[0]:
        cur = materialize(_star(_star(cur, True), False), "components")
        now = mark(cur)
        if now == before:
            break
        before = now
    label = cur.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("label"))
    return label.unionByName(label.select(F.col("label").alias("node"), "label").distinct())
