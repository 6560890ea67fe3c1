"""Communities by modularity gain with graph contraction.

Level by level, communities move into a neighbour where that raises the modularity, and the graph
contracts to one node per community, until no move gains. Two communities a and b with w edges
between them and degree sums D gain 2 m w - D_a D_b (in units of 1 / (2 m^2)); all of it is exact
integer arithmetic in decimals.

A round: every community picks the neighbour with the greatest gain, if that is positive (ties by a
hash of the pair and the round). Communities that pick each other, or that a hash makes movers
and whose pick is none, move at once. Candidates of one goal b are judged against all of them
together: a joins if 2 m w - D_a (D_b + D of all other candidates) is positive, a lower bound of what
it still gains once the others have joined, so the modularity rises with every move taken. If that
holds for no candidate, the one with the greatest gain joins. The pair that comes first in the order
of picks always picks each other, so every round with a gain left makes a move.

Groups are summed, never collected or sorted, so a goal with many candidates is no hot spot beyond a
partial aggregate and a join that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.edges import degrees
from quarry.session import stored

WIDE = "decimal(38,0)"
# Levels after which the nodes' labels, which only the end needs, are written.
LABELS_EVERY = 4


def _tie(a: str, b: str, level: int) -> Column:
    low, high = F.least(a, b).cast("string"), F.greatest(a, b).cast("string")
    return F.md5(F.concat_ws("|", low, high, F.lit(str(level))).cast("binary"))


def _moves(d: DataFrame, w: DataFrame, m: int, level: int) -> DataFrame:
    """(c, into): the moves of one round."""
    ends = w.select("a", "b", "w").unionByName(w.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    pairs = ends.join(d.select(F.col("c").alias("a"), F.col("d").alias("da")), "a") \
        .join(d.select(F.col("c").alias("b"), F.col("d").alias("db")), "b")
    big = F.lit(2 * m).cast(WIDE)
    pairs = pairs.withColumn("gain", big * F.col("w").cast(WIDE) - F.col("da").cast(WIDE) * F.col("db").cast(WIDE)).filter("gain > 0")
    first = F.struct("gain", _tie("a", "b", level).alias("tie"), "b", "da", "db", "w")
    picks = stored(pairs.groupBy("a").agg(F.max(first).alias("p")).select("a", "p.*"))
    back = picks.select(F.col("a").alias("b"), F.col("b").alias("back"))
    mover = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("a").cast("string"), F.lit(str(level))).cast("binary")), 1, 1), 16, 10).cast("int") % 2 == 1
    moving = picks.join(back, "b", "left").withColumn(
        "moves", F.when(F.col("back").eqNullSafe(F.col("a")), F.col("a") > F.col("b")).otherwise(mover))
    still = moving.filter("not moves").select(F.col("a").alias("b"))
    cand = moving.filter("moves").join(still, "b", "left_semi")
    total = cand.groupBy("b").agg(F.sum(F.col("da").cast(WIDE)).cast(WIDE).alias("all_d"),
                                  F.min(F.struct((-F.col("gain")).alias("g"), "a")).alias("best"))
    judged = cand.join(total, "b").withColumn(
        "fits", big * F.col("w").cast(WIDE) - F.col("da").cast(WIDE) * (F.col("db").cast(WIDE) + F.col("all_d") - F.col("da").cast(WIDE)) > 0)
    some = judged.groupBy("b").agg(F.max("fits").alias("some"))
    taken = judged.join(some, "b").filter(F.col("fits") | (~F.col("some") & (F.col("best.a") == F.col("a"))))
    return taken.select(F.col("a").alias("c"), F.col("b").alias("into"))


def communities(edges: DataFrame) -> DataFrame:
    """``node, label``: the label is the smallest node of the community. ``edges`` are canonical
    (``edges.canonical``); a node without an edge is not in them."""
    edges = stored(edges.select("src", "dst"))
    m = edges.count()
    start = stored(degrees(edges))
    labels = start.select("node", F.col("node").alias("c"))
    d = start.select(F.col("node").alias("c"), F.col("degree").cast("decimal(20,0)").alias("d"))
    w = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(1).cast("bigint").alias("w"))
    level = 0
    while True:
        level += 1
        moves = stored(_moves(d, w, m, level))
        if moves.isEmpty():
            break

        def moved(df: DataFrame, column: str, moves: DataFrame = moves) -> DataFrame:
            to = moves.select(F.col("c").alias(column), "into")
            return df.join(to, column, "left").withColumn(column, F.coalesce("into", column)).drop("into")

        labels = moved(labels, "c")
        if level % LABELS_EVERY == 0:
            labels = stored(labels)
        d = stored(moved(d, "c").groupBy("c").agg(F.sum("d").cast("decimal(20,0)").alias("d")))
        ends = moved(moved(w, "a"), "b").filter("a != b")
        w = stored(ends.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("w").alias("w")))
    labels = stored(labels)
    smallest = labels.groupBy("c").agg(F.min("node").alias("label"))
    return labels.join(smallest, "c").select("node", "label")
