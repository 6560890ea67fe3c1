"""Graph searches, scores and communities against plain versions."""

import itertools
import random
from collections import deque

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.operators import graph
from quarry.operators import graph as G
from quarry.operators import graph_paths, graph_tasks


def frame(spark, pairs):
    return G.canonical(spark.createDataFrame([tuple(p) for p in pairs] or [(1, 1)], "src long, dst long"))


def random_pairs(seed, n, m):
    rng = random.Random(seed)
    return sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)})


def adjacency(pairs):
    adj = {}
    for a, b in pairs:
        adj.setdefault(a, set()).add(b)
        adj.setdefault(b, set()).add(a)
    return adj


def distances(adj, s):
    dist, todo = {s: 0}, deque([s])
    while todo:
        x = todo.popleft()
        for y in adj.get(x, ()):
            if y not in dist:
                dist[y] = dist[x] + 1
                todo.append(y)
    return dist


def plain_dependencies(adj, s):
    dist = distances(adj, s)
    sigma = {s: 1}
    for x in sorted(dist, key=dist.get):
        if x != s:
            sigma[x] = sum(sigma[y] for y in adj[x] if dist.get(y, -1) == dist[x] - 1)
    dep = dict.fromkeys(dist, 0.0)
    for x in sorted(dist, key=dist.get, reverse=True):
        for y in adj[x]:
            if dist[y] == dist[x] - 1:
                dep[y] += sigma[y] / sigma[x] * (1 + dep[x])
    dep[s] = 0.0
    return dep


def test_path_of_a_ladder(spark):
    hub = 2
    # 0..5 with detours, a hub behind node 3, and a part that cannot be reached
    pairs = [(i, i + 1) for i in range(5)] + [(i, 100 + i) for i in range(5)] + [(100 + i, i + 1) for i in range(5)]
    pairs += [(3, 1000 + i) for i in range(30)] + [(2000, 2001)]
    e = frame(spark, pairs)
    path = G.shortest_path(e, 0, 5, hub).orderBy("step").collect()
    assert [(r.step, r.node) for r in path] == [(i, i) for i in range(6)]
    adj = adjacency(pairs)
    assert G.shortest_path(e, 0, 2001, hub).count() == 0
    assert [tuple(r) for r in G.shortest_path(e, 7, 7, hub).collect()] == [(0, 7)]
    dist = distances(adj, 0)
    rows = G.search(e, spark.createDataFrame([(0,), (0,), (5555,)], "source long"), hub=hub).collect()
    assert {r.node: r.dist for r in rows if r.source == 0} == dist and [r.node for r in rows if r.source == 5555] == [5555]
    for r in rows:
        if r.parent is not None:
            assert r.parent == min(y for y in adj[r.node] if dist[y] == r.dist - 1)


def test_closeness_and_betweenness(spark):
    pairs = [*random_pairs(1, 9, 14), (100, 101), (101, 102)]
    adj, e = adjacency(pairs), frame(spark, pairs)
    n = len(adj)
    deps = {s: plain_dependencies(adj, s) for s in adj}
    exact = {v: sum(d.get(v, 0) for d in deps.values()) / ((n - 1) * (n - 2)) for v in adj}
    got = {r.node: r for r in G.betweenness(e, hub=3).collect()}
    assert set(got) == set(adj)
    assert all(abs(got[v].betweenness - exact[v]) < 1e-9 and got[v].std_error == 0 for v in adj)
    chosen = [r.source for r in G.pivots(e, 5).collect()]
    assert chosen == [r.source for r in G.pivots(e.repartition(7), 5).collect()] and len(set(chosen)) == 5
    for r in G.betweenness(e, spark.createDataFrame([(c,) for c in chosen], "source long")).collect():
        mine = np.array([deps[c].get(r.node, 0.0) for c in chosen]) * n / ((n - 1) * (n - 2))
        assert abs(r.betweenness - mine.mean()) < 1e-9 and abs(r.std_error - mine.std(ddof=1) / 5 ** 0.5) < 1e-9
    for r in G.closeness(e, spark.createDataFrame([(c,) for c in chosen], "source long")).collect():
        d = [x for x in distances(adj, r.node).values() if x]
        assert abs(r.closeness - len(d) / sum(d) * len(d) / (n - 1)) < 1e-9
    every = [d for s in adj for d in distances(adj, s).values() if d]
    row = G.path_stats(e).first()
    assert (row.diameter, row.reachable_pairs) == (max(every), len(every)) and abs(row.average_path_length - sum(every) / len(every)) < 1e-9


def test_distances_between_all_pairs(spark):
    # several blocks of sources, hubs in several shares, parts apart
    pairs = [*random_pairs(4, 200, 700), (5000, 5001)]
    adj, e = adjacency(pairs), frame(spark, pairs)
    expected = {}
    for s in adj:
        for d in distances(adj, s).values():
            if d:
                expected[s, d] = expected.get((s, d), 0) + 1
    assert {(r.node, r.dist): r.n for r in G.distance_counts(e, 5, 900).collect()} == expected
    whole = {r.node: r.betweenness for r in G.betweenness(frame(spark, pairs[:40])).collect()}
    split = {r.node: r.betweenness for r in G.betweenness(frame(spark, pairs[:40]), batch_pairs=3000).collect()}
    assert set(whole) == set(split) and all(abs(whole[x] - split[x]) < 1e-9 for x in whole)


def test_all_pairs_write_one_row_for_a_block_of_sources(spark, monkeypatch):
    # parts that do not meet: a random one, a chain and a hub
    pairs = [*random_pairs(7, 150, 500), *((i, i + 1) for i in range(5000, 5012)), *((9000, 9001 + i) for i in range(60))]
    adj, e, rows = adjacency(pairs), frame(spark, pairs), []
    n = len(adj)

    def counted(df, real=graph_paths.stored):
        out = real(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(graph_paths, "stored", counted)
    got = {(r.node, r.dist): r.n for r in graph_paths.distance_counts(e).collect()}
    expected = {}
    for s in adj:
        for d in distances(adj, s).values():
            if d:
                expected[s, d] = expected.get((s, d), 0) + 1
    assert got == expected
    assert sum(rows) <= n + 1 + 13  # the nodes, one part, a row a round; before: a row a node and round
    monkeypatch.undo()
    assert {(r.node, r.dist): r.n for r in graph_paths.distance_counts(e, 300, n, words=1).collect()} == expected
    named = e.select(F.concat(F.lit("u"), "src").alias("src"), F.concat(F.lit("u"), "dst").alias("dst"))
    assert {(r.node, r.dist): r.n for r in graph_paths.distance_counts(named, 300, words=2).collect()} == {
        (f"u{v}", d): c for (v, d), c in expected.items()}


def tasks_adjacency(pairs):
    # nodes are numbered from 0; two parts, one of them given twice
    adj = adjacency(pairs)
    n, half = len(adj), len(adj) // 2
    lists = [pa.array([{"id": v, "next": sorted(adj[v])} for v in r],
                      pa.struct([("id", pa.int32()), ("next", pa.list_(pa.int32()))])) for r in (range(half), range(half, n))]
    g = graph_tasks.Adjacency(n)
    for part in (1, 0, 1):
        g.add(part, lists[part])
    return adj, g.ready()


@pytest.mark.parametrize("cost,words", [(0, 1), (0.5, 2), (1e9, 3)])
def test_rounds_inside_a_task(monkeypatch, cost, words):
    # new bits sent or met, a hub beyond the aligned neighbours, a chain, two nodes apart
    monkeypatch.setattr(graph_tasks, "SEND_COST", cost)
    monkeypatch.setattr(graph_tasks, "ALIGNED", 20)
    monkeypatch.setattr(graph_tasks, "ROWS", 50)
    rng = random.Random(words)
    pairs = {tuple(sorted(rng.sample(range(150), 2))) for _ in range(400)} | {(i, i + 1) for i in range(190)} | {(150, i) for i in range(191, 260)}
    adj, g = tasks_adjacency(sorted(pairs | {(260, 261)}))
    expected = {}
    for v in adj:
        for d in distances(adj, v).values():
            if d:
                expected[v, d] = expected.get((v, d), 0) + 1
    got = {}
    for task in range(2):
        for out in graph_tasks.distances(len(adj), words, 30, 2)(g, [{"task": task}]):
            got |= {(r["id"], r["dist"]): r["n"] for r in out.to_pylist()}
    assert got == expected


@pytest.mark.parametrize("seed,edges", [(1, 90), (2, 900)])
def test_dependencies_inside_a_task(seed, edges):
    rng = random.Random(seed)
    pairs = {tuple(sorted(rng.sample(range(80), 2))) for _ in range(edges)} | {(i, i + 1) for i in range(99)} | {(100, 101)}
    adj, g = tasks_adjacency(sorted(pairs))
    for own, sources in (([{"task": 0}, {"task": 1}], list(adj)), ([{"task": 0, "sources": [3, 100, 7]}], [3, 100, 7])):
        deps = [plain_dependencies(adj, v) for v in sources]
        out = [r for b in graph_tasks.dependencies(len(adj), 25, 2)(g, own) for r in b.to_pylist()]
        got = {r["id"]: (r["s"], r["ss"]) for r in out}
        for v in adj:
            want = [d.get(v, 0.0) for d in deps]
            assert np.allclose(got.get(v, (0.0, 0.0)), (sum(want), sum(x * x for x in want)), rtol=1e-12, atol=1e-12)


def test_searches_from_every_node_write_nothing_between_rounds(spark, monkeypatch):
    pairs, calls = [(i, i + 1) for i in range(40)], []
    e = frame(spark, pairs)
    monkeypatch.setattr(graph_paths, "stored", lambda df, real=graph_paths.stored: calls.append(1) or real(df))
    got = {(r.node, r.dist): r.n for r in graph_paths.distance_counts(e).collect()}
    assert got == {(v, d): (v + d <= 40) + (v >= d) for v in range(41) for d in range(1, 41) if v + d <= 40 or v >= d}
    rows = {r.node: r.betweenness for r in G.betweenness(e).collect()}
    assert all(abs(rows[v] - 2 * v * (40 - v) / (40 * 39)) < 1e-12 for v in range(41))
    # the nodes and the parts of each search; before, a table for each of 40 levels
    assert len(calls) == 4


def test_path_queries_start_from_every_node(spark):
    from quarry.plans import queries_graph as Q
    sf = "/root/testdata/sf0.001"
    n = G.nodes(Q.dense(spark, sf)).count()
    assert Q.q_n11(spark, sf).count() == n
    assert Q.q_n11p(spark, sf).first().reachable_pairs == n * (n - 1)
    assert Q.q_n12(spark, sf).columns == ["node", "betweenness"]


def test_leaves_take_no_part_in_the_rounds(spark, monkeypatch):
    for seed, pairs in ((1, [(0, i) for i in range(1, 40)]), (2, random_pairs(2, 40, 24) + [(50, 51), (3, 60), (60, 61), (2, 70)]), (3, [(i, i + 1) for i in range(40)])):
        first = []
        real = graph._large_star
        monkeypatch.setattr(graph, "_large_star", lambda e: (first.append(e.count()), real(e))[1])
        e, adj = frame(spark, pairs), adjacency(pairs)
        label = {r.node: r.label for r in G.connected_components(e).collect()}
        monkeypatch.setattr(graph, "_large_star", real)
        assert label == {x: min(distances(adj, x)) for x in adj}
        leaves = sum(len(ys) == 1 and min(ys) < x for x, ys in adj.items())
        assert first[0] == len({tuple(sorted(p)) for p in pairs}) - leaves and leaves


def test_adjacency_without_hubs_joins_nothing(spark, monkeypatch):
    from quarry.operators import graph_paths as GP
    plans = []
    real = GP.laid_out
    monkeypatch.setattr(GP, "laid_out", lambda df, keys: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), real(df, keys))[1])
    pairs = random_pairs(4, 30, 80)
    e, adj = frame(spark, pairs), adjacency(pairs)
    GP.shared_adjacency(e)
    assert "Join" not in plans[0]
    hub = max(map(len, adj.values())) - 1
    rows = GP.shared_adjacency(e, hub)[0].collect()
    assert sorted((r.node, r.nxt) for r in rows) == sorted((x, y) for x, ys in adj.items() for y in ys)
    assert all(r.nxt_shares == -(-len(adj[r.nxt]) // hub) for r in rows) and {r.share for r in rows} == {0, 1}


def test_search_of_a_long_path_is_held_against_two_levels(spark):
    pairs = [(i, i + 1) for i in range(9)] + [(0, 2), (4, 6), (20, 21)]
    e, adj = frame(spark, pairs), adjacency(pairs)
    rows = G.search(e, spark.createDataFrame([(0,), (5,)], "source long")).collect()
    for s in (0, 5):
        dist = distances(adj, s)
        assert sorted((r.node, r.dist) for r in rows if r.source == s) == sorted(dist.items())
    assert all(r.parent == min(y for y in adj[r.node] if distances(adj, r.source)[y] == r.dist - 1) for r in rows if r.dist)
    path = sorted(map(tuple, G.shortest_path(e, 0, 9).collect()))
    assert path == [(0, 0), (1, 2), (2, 3), (3, 4), (4, 6), (5, 7), (6, 8), (7, 9)]


def test_triangles_move_lists_not_pairs(spark):
    pairs = random_pairs(5, 24, 110) + [(0, 100 + i) for i in range(9)]
    adj, e = adjacency(pairs), frame(spark, pairs)
    for k, out in ((3, G.triangles(e)), (4, G.four_cliques(e))):
        expected = [c for c in itertools.combinations(sorted(adj), k) if all(y in adj[x] for x, y in itertools.combinations(c, 2))]
        assert sorted(tuple(r) for r in out.collect()) == expected and expected
        # no join of two neighbours of a node row by row
        assert "array_intersect" in out._jdf.queryExecution().optimizedPlan().toString()


def test_scores_stand_still(spark):
    hub = 4
    pairs = random_pairs(2, 16, 60) + [(0, 100 + i) for i in range(6)]
    e, ids = frame(spark, pairs), sorted(adjacency(pairs))
    at = {x: i for i, x in enumerate(ids)}
    a = np.zeros((len(ids), len(ids)))
    for x, y in pairs:
        a[at[x], at[y]] = a[at[y], at[x]] = 1
    p = np.linalg.solve(np.eye(len(ids)) - 0.85 * (a / a.sum(axis=0)), np.full(len(ids), 0.15 / len(ids)))
    got = {r.node: r.pagerank for r in G.pagerank(e, tolerance=1e-7, hub=hub).collect()}
    assert set(got) == set(ids) and max(abs(got[x] - p[at[x]]) for x in ids) < 1e-6
    v = np.abs(np.linalg.eigh(a)[1][:, -1])
    got = {r.node: r.eigenvector for r in G.eigenvector(e, tolerance=1e-5, hub=hub).collect()}
    assert max(abs(got[x] - v[at[x]]) for x in ids) < 1e-4


def test_rounds_do_not_move_the_edges(spark):
    from quarry.operators.graph_paths import shared_adjacency, to_shares
    adj, d = shared_adjacency(frame(spark, random_pairs(3, 30, 90)))
    joined = to_shares(d).join(adj.hint("merge"), ["node", "share"])
    joined.collect()
    plan = joined._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    # the vector is dealt to the edges; they are read in their buckets
    assert plan.count("Exchange hashpartitioning(node") == 1 and "Bucketed: true" in plan, plan


def gains(adj, label, m):
    d, w = {}, {}
    for x, ys in adj.items():
        d[label[x]] = d.get(label[x], 0) + len(ys)
        for y in ys:
            if label[x] != label[y]:
                w[label[x], label[y]] = w.get((label[x], label[y]), 0) + 1
    return [2 * m * n - d[a] * d[b] for (a, b), n in w.items()]


def test_communities_leave_no_gain(spark):
    seed = 1
    rng = random.Random(seed)
    groups = [range(10 * g, 10 * g + 8) for g in range(4)]
    pairs = {p for g in groups for p in itertools.combinations(g, 2) if rng.random() < 0.7}
    pairs |= {(groups[i][0], groups[(i + 1) % 4][1]) for i in range(4)} | set(random_pairs(seed, 38, 8))
    pairs = {tuple(sorted(p)) for p in pairs if p[0] != p[1]}
    adj = adjacency(pairs)
    label = {r.node: r.label for r in G.communities(frame(spark, pairs)).collect()}
    assert set(label) == set(adj) and all(label[x] == min(y for y in label if label[y] == label[x]) for x in label)
    assert max(gains(adj, label, len(pairs)), default=0) <= 0 and 1 < len(set(label.values())) <= 8


def test_communities_of_a_star_and_none(spark):
    star = frame(spark, [(0, i) for i in range(1, 300)] + [(1000, 1001)])
    label = {r.node: r.label for r in G.communities(star).collect()}
    assert set(label.values()) == {0, 1000}
    empty = frame(spark, [])
    for out in (G.communities(empty), G.pagerank(empty), G.eigenvector(empty), G.betweenness(empty), G.closeness(empty),
                G.label_propagation(empty), G.connected_components(empty)):
        assert out.count() == 0


def test_label_propagation_ends(spark):
    # a bipartite pair swaps labels for ever under the synchronous rule
    rows = {r.node: r.label for r in G.label_propagation(frame(spark, [(1, 2), (10, 11), (11, 12), (10, 12)])).collect()}
    assert set(rows) == {1, 2, 10, 11, 12} and len({rows[x] for x in (10, 11, 12)}) == 1
