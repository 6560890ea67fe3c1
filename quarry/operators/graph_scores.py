"""Scores that a graph's nodes give each other until they stand still.

Each round sends every node's value along the adjacency, which is laid out once by (node, share) and
never moves again: a round shuffles the vector to it and the partial sums of the answers, and a node
of high degree sends and is summed in shares. The round's one aggregate holds a node's old value
beside the new one, so the change is read from the round's own (checkpointed) result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.graph_paths import HUB, shared_adjacency, to_shares
from quarry.session import stored


def _flows(x: DataFrame, adj: DataFrame, sent) -> DataFrame:
    """One round: ``node, degree, shares, old`` and ``flow``, the sum of ``sent`` over the neighbours."""
    out = to_shares(x.withColumn("sent", sent).select("node", "shares", "sent")).join(adj, ["node", "share"])
    parts = out.groupBy(F.col("nxt").alias("node")).agg(F.sum("sent").alias("flow"))
    own = x.select("node", F.lit(0.0).alias("flow"), "degree", "shares", F.col("x").alias("old"))
    both = parts.select("node", "flow", *[F.lit(None).cast(own.schema[c].dataType).alias(c) for c in ("degree", "shares", "old")])
    return both.unionByName(own).groupBy("node").agg(F.sum("flow").alias("flow"), F.max("degree").alias("degree"),
                                                     F.max("shares").alias("shares"), F.max("old").alias("old"))


def pagerank(edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-9, hub: int = HUB,
             rounds: int | None = None) -> DataFrame:
    """PageRank over both edge directions, from the uniform start until the ranks of a round
    differ by no more than ``tolerance`` in sum, or for ``rounds`` rounds. Every node has an edge, so no rank is lost."""
    adj, d = shared_adjacency(edges, hub)
    n = d.count()
    x = d.select("node", "degree", "shares", F.lit(1.0 / max(n, 1)).alias("x"))
    done = 0
    while n and done != rounds:
        done += 1
        new = (1 - damping) / n + damping * F.col("flow")
        x = stored(_flows(x, adj, F.col("x") / F.col("degree")).select("node", "degree", "shares", "old", new.alias("x")))
        if x.agg(F.sum(F.abs(F.col("x") - F.col("old")))).first()[0] <= tolerance:
            break
    return x.select("node", F.col("x").alias("pagerank"))


def eigenvector(edges: DataFrame, tolerance: float = 1e-9, hub: int = HUB, rounds: int | None = None) -> DataFrame:
    """The leading eigenvector, of length 1, by power iteration on A + I until a round moves it
    by no more than ``tolerance`` (in length), or for ``rounds`` rounds. Components beside the leading one fade to 0."""
    adj, d = shared_adjacency(edges, hub)
    n = d.count()
    x = d.select("node", "degree", "shares", F.lit(max(n, 1) ** -0.5).alias("x"))
    done = 0
    while n and done != rounds:
        done += 1
        y = stored(_flows(x, adj, F.col("x")).select("node", "degree", "shares", "old", (F.col("flow") + F.col("old")).alias("y")))
        norm = y.agg(F.sqrt(F.sum(F.col("y") * F.col("y")))).first()[0]
        x = y.select("node", "degree", "shares", "old", (F.col("y") / norm).alias("x"))
        if x.agg(F.sqrt(F.sum(F.pow(F.col("x") - F.col("old"), 2)))).first()[0] <= tolerance:
            break
    return x.select("node", F.col("x").alias("eigenvector"))
