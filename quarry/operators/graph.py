"""Graph operators on edge-list DataFrames (SURVEY N*).

Edges are canonical (``edges.canonical``). Searches and the scores on them are in ``graph_paths``,
scores by iteration in ``graph_scores``, communities in ``communities``; this module offers all of
them. Iterative operators are driver loops of join + aggregate rounds, each written with a reliable
checkpoint; only a tiny aggregate (a count, a checksum, a sum of changes) reaches the driver.
Triangle-type enumeration orients each edge from the endpoint with the lower (degree, id) to the
higher one; every node then has at most sqrt(2m) out-neighbours, so the wedge join is bounded by
O(m^1.5) and a high-degree hub never expands its full neighbour list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.communities import communities
from quarry.operators.edges import both_directions, canonical, degrees, nodes
from quarry.operators.graph_paths import (betweenness, closeness, distance_counts, path_stats, pivots, search, shared_adjacency,
                                          shortest_path, to_shares)
from quarry.operators.graph_scores import eigenvector, pagerank
from quarry.session import cut_lineage, stored

__all__ = ["betweenness", "bfs", "both_directions", "canonical", "closeness", "clustering", "clustering_summary", "communities",
           "component_sizes", "connected_components", "degree_centrality", "degree_distribution", "degrees", "distance_counts", "eigenvector",
           "four_cliques", "highest_degree", "label_propagation", "modularity", "nodes", "oriented", "pagerank", "path_stats",
           "pivots", "search", "shortest_path", "shortest_path_length", "summary", "triangles"]


def summary(edges: DataFrame) -> DataFrame:
    """Edge count, node count, average degree 2E/N, density 2E/(N(N-1))."""
    d = degrees(edges)
    g = d.agg(F.count(F.lit(1)).alias("n_nodes"), (F.sum("degree") / 2).cast("bigint").alias("n_edges"))
    n = F.col("n_nodes").cast("double")
    return g.select("n_edges", "n_nodes", (2 * F.col("n_edges") / n).alias("average_degree"),
                    F.when(n > 1, 2 * F.col("n_edges") / (n * (n - 1))).alias("density"))


def highest_degree(edges: DataFrame) -> DataFrame:
    """Node with the largest degree (ties: smallest id)."""
    return degrees(edges).orderBy(F.col("degree").desc(), F.col("node")).limit(1)


def degree_distribution(edges: DataFrame) -> DataFrame:
    """Number of nodes per degree."""
    return degrees(edges).groupBy("degree").agg(F.count(F.lit(1)).alias("n_nodes"))


def degree_centrality(edges: DataFrame) -> DataFrame:
    """Degree / (N - 1); N is a scalar subquery."""
    d = degrees(edges)
    n = d.agg(F.count(F.lit(1))).scalar()
    return d.select("node", "degree", (F.col("degree") / (n - 1)).alias("centrality"))


# ------------------------------------------------------------------ triangles


def oriented(edges: DataFrame) -> DataFrame:
    """Edges directed from lower (degree, id) to higher (degree, id)."""
    d = degrees(edges)
    da = d.select(F.col("node").alias("src"), F.col("degree").alias("da"))
    db = d.select(F.col("node").alias("dst"), F.col("degree").alias("db"))
    e = edges.join(da, "src").join(db, "dst")
    forward = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("src") < F.col("dst")))
    return e.select(F.when(forward, F.col("src")).otherwise(F.col("dst")).alias("u"),
                    F.when(forward, F.col("dst")).otherwise(F.col("src")).alias("v"))


def _out_lists(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lists, later) of the oriented edges: ``v, own``, the out-neighbours of each node, and
    ``u, v, rest`` for each edge u -> v: u's out-neighbours that come after v by (degree, id), which
    are all that can close a triangle over it."""
    d = stored(degrees(edges))
    da = d.select(F.col("node").alias("src"), F.col("degree").alias("da"))
    db = d.select(F.col("node").alias("dst"), F.col("degree").alias("db"))
    x, y = F.struct(F.col("da").alias("d"), F.col("src").alias("n")), F.struct(F.col("db").alias("d"), F.col("dst").alias("n"))
    o = edges.join(da, "src").join(db, "dst").select(F.least(x, y).alias("u"), F.greatest(x, y).alias("v"))
    lists = stored(o.groupBy(F.col("u.n").alias("u")).agg(F.array_sort(F.collect_list("v")).alias("out"))
                   .select("u", F.transform("out", lambda v: v["n"]).alias("out")))
    later = lists.select("u", F.posexplode("out").alias("at", "v"), "out").filter(F.col("at") + 1 < F.size("out")) \
        .select("u", "v", F.slice("out", F.col("at") + 2, F.size("out")).alias("rest"))
    return lists.select(F.col("u").alias("v"), F.col("out").alias("own")), later


def _closing(lists: DataFrame, later: DataFrame) -> DataFrame:
    """``u, v, rest`` with the nodes of ``rest`` that are also out-neighbours of v, where there are any.
    The lists of v are the built side, at most sqrt(2m) long each; the others pass by unsorted."""
    met = later.join(lists.hint("shuffle_hash"), "v")
    return met.withColumn("rest", F.array_intersect("rest", "own")).drop("own").filter(F.size("rest") > 0)


def triangles(edges: DataFrame) -> DataFrame:
    """Every triangle once, as sorted ids (a < b < c). What moves is one list per edge, not one
    row per pair of neighbours."""
    t = _closing(*_out_lists(edges)).select("u", "v", F.explode("rest").alias("w"))
    arr = F.array_sort(F.array("u", "v", "w"))
    return t.select(arr[0].alias("a"), arr[1].alias("b"), arr[2].alias("c"))


def clustering(edges: DataFrame) -> DataFrame:
    """Per node triangles and local clustering 2T/(d(d-1)) (0 when d < 2)."""
    t = triangles(edges)
    per = (t.select(F.explode(F.array("a", "b", "c")).alias("node"))
            .groupBy("node").agg(F.count(F.lit(1)).alias("triangles")))
    d = degrees(edges)
    j = d.join(per, "node", "left").fillna({"triangles": 0})
    c = F.when(F.col("degree") > 1, 2 * F.col("triangles") / (F.col("degree") * (F.col("degree") - 1))).otherwise(0.0)
    return j.select("node", "degree", "triangles", c.alias("clustering"))


def clustering_summary(edges: DataFrame) -> DataFrame:
    """Triangle count, average clustering, transitivity 3T / wedges."""
    c = clustering(edges)
    return c.agg((F.sum("triangles") / 3).cast("bigint").alias("triangles"), F.avg("clustering").alias("average_clustering"),
                 (F.sum("triangles") / F.nullif(F.sum(F.col("degree") * (F.col("degree") - 1) / 2), F.lit(0)))
                 .alias("transitivity"))


def four_cliques(edges: DataFrame) -> DataFrame:
    """Every 4-clique once, as sorted ids (a < b < c < d).

    A 4-clique u, v, w, x in the order of (degree, id) is a triangle u, v, w
    and an x behind w that closes it over each of them. The lists of
    ``triangles`` hold what closes u, v; they go on to w the same way, so
    only bounded out-neighbour lists are ever met.
    """
    lists, later = _out_lists(edges)
    two = _closing(lists, later)
    rest = two.select("u", F.col("v").alias("t"), F.posexplode("rest").alias("at", "v"), "rest").filter(F.col("at") + 1 < F.size("rest")) \
        .select("u", "t", "v", F.slice("rest", F.col("at") + 2, F.size("rest")).alias("rest"))
    c = _closing(lists, rest).select("u", "t", "v", F.explode("rest").alias("x"))
    arr = F.array_sort(F.array("u", "t", "v", "x"))
    return c.select(*[arr[i].alias(n) for i, n in enumerate("abcd")])


# ------------------------------------------------------------------ BFS


def bfs(edges: DataFrame, sources: DataFrame, target=None) -> DataFrame:
    """(source, node, dist) of every node that a source reaches; see ``graph_paths.search``."""
    return search(edges, sources, target).select("source", "node", "dist")


def shortest_path_length(edges: DataFrame, source, target) -> DataFrame:
    """Hops between two nodes; NULL when unreachable (one row)."""
    spark = edges.sparkSession
    src = spark.range(1).select(F.lit(source).alias("source"))
    dist = bfs(edges, src, target)
    hit = dist.filter(F.col("node") == F.lit(target)).agg(F.min("dist").alias("length"))
    return hit.select(F.lit(source).alias("source"), F.lit(target).alias("target"), "length")


# ------------------------------------------------------------------ components and communities


def _mark(df: DataFrame, *columns: str) -> tuple:
    """Count and checksum of a duplicate-free table."""
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("h")).first()
    return r.n, r.h


def connected_components(edges: DataFrame, method: str = "star") -> DataFrame:
    """Component label = smallest node id in the component.

    ``method="star"`` (default): alternating large-star / small-star rounds
    (Kiveris et al., "Connected Components in MapReduce and Beyond", 2014).
    Each round is a grouped min over the adjacency and a join; the
    graph contracts to stars around each component's minimum in O(log n)
    rounds, independent of the diameter. Nodes whose only neighbour is smaller
    take no part in the rounds: their label is that neighbour's.
    ``method="propagate"``: plain min-label propagation (O(diameter) rounds).
    """
    if method == "propagate":
        return _propagate_components(edges)
    pairs = stored(edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")))
    ends = pairs.select(F.col("b").alias("node"), F.col("a").alias("smaller")).unionByName(
        pairs.select(F.col("a").alias("node"), F.lit(None).alias("smaller")))
    ends = stored(ends.groupBy("node").agg(((F.count(F.lit(1)) == 1) & (F.count("smaller") == 1)).alias("leaf"),
                                           F.min("smaller").alias("smaller")))
    leaves = ends.filter("leaf").select("node", "smaller")
    cur = stored(pairs.join(leaves.select(F.col("node").alias("b")), "b", "left_anti").filter("a != b").select("a", "b"))
    before = _mark(cur, "a", "b")
    while True:
        cur = stored(_small_star(_large_star(cur)))
        now = _mark(cur, "a", "b")
        if now == before:
            break
        before = now
    # stars: every non-minimum node is attached to its component minimum
    attached = cur.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("label"))
    inner = stored(ends.filter("not leaf").select("node").join(attached, "node", "left")
                   .select("node", F.coalesce("label", F.col("node")).alias("label")))
    # the one neighbour of a leaf is no leaf
    outer = leaves.join(inner.withColumnRenamed("node", "smaller"), "smaller").select("node", "label")
    return inner.unionByName(outer)


def _smallest(e: DataFrame) -> DataFrame:
    """The smallest neighbour of every node that has a smaller one (edges a < b)."""
    return e.groupBy("b").agg(F.min("a").alias("m"))


def _large_star(e: DataFrame) -> DataFrame:
    """Connect every strictly larger neighbour of u to min(N(u) + u)."""
    m = _smallest(e).withColumnRenamed("b", "a")
    return e.join(m, "a", "left").select(F.coalesce("m", "a").alias("a"), "b").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Connect u and its smaller-or-equal neighbours to their minimum."""
    m = _smallest(e)
    out = e.join(m, "b").filter("a != m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return out.unionByName(m.select(F.col("m").alias("a"), "b")).distinct()


def _propagate_components(edges: DataFrame) -> DataFrame:
    """Component label = smallest node id in the component.

    Min-label propagation: each round every node takes the smallest label
    among itself and its neighbours; stops when no label changes.
    """
    adj = both_directions(edges)
    lab = nodes(edges).select("node", F.col("node").alias("label"))
    k = 0
    while True:
        k += 1
        nb = adj.join(lab.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")) \
                .agg(F.min("label").alias("nl"))
        new = lab.join(nb, "node", "left").select("node", F.least("label", F.coalesce("nl", F.col("label"))).alias("label"),
                                                   (F.col("nl") < F.col("label")).alias("changed"))
        new = cut_lineage(new)
        if new.filter("changed").isEmpty():
            return new.select("node", "label")
        lab = new.select("node", "label")


def component_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("label").agg(F.count(F.lit(1)).alias("size"))


def label_propagation(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """Synchronous label propagation: every node takes its neighbours' most frequent label
    (ties: smallest label), until the labels are those of an earlier round (as a rule the last one:
    nothing changes any more; else the rule goes round in a cycle, whose first labels are kept), or
    for ``rounds`` rounds."""
    adj, d = shared_adjacency(edges)
    lab = d.select("node", "shares", F.col("node").alias("label"))
    seen: set[tuple] = set()
    while rounds is None or len(seen) < rounds:
        votes = to_shares(lab).join(adj, ["node", "share"]).groupBy(F.col("nxt").alias("node"), "label").agg(
            F.count(F.lit(1)).alias("votes"), F.first("nxt_shares").alias("shares"))
        best = votes.groupBy("node").agg(F.min(F.struct((-F.col("votes")).alias("v"), "label")).alias("b"), F.first("shares").alias("shares"))
        lab = stored(best.select("node", "shares", "b.label"))
        now = _mark(lab, "node", "label")
        if now in seen:
            break
        seen.add(now)
    return lab.select("node", "label")


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Q = sum_c (L_c / m - (D_c / 2m)^2)."""
    m = edges.agg(F.count(F.lit(1))).scalar()
    la = labels.select(F.col("node").alias("src"), F.col("label").alias("la"))
    lb = labels.select(F.col("node").alias("dst"), F.col("label").alias("lb"))
    inside = (edges.join(la, "src").join(lb, "dst").filter(F.col("la") == F.col("lb"))
              .groupBy(F.col("la").alias("label")).agg(F.count(F.lit(1)).alias("lc")))
    deg = degrees(edges).join(labels, "node").groupBy("label").agg(F.sum("degree").alias("dc"))
    j = deg.join(inside, "label", "left").fillna({"lc": 0})
    return j.agg(F.sum(F.col("lc") / m - (F.col("dc") / (2 * m)) * (F.col("dc") / (2 * m))).alias("modularity"),
                 F.count(F.lit(1)).alias("communities"))
