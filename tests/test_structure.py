"""Graph algorithms against plain Python on random graphs."""

from collections import defaultdict, deque

import pytest
from graphs import make, random_graph
from pyspark.sql import functions as F

from knotwork.operators import centrality, structure, traverse


def undirected(pairs):
    adj = defaultdict(set)
    for a, b in pairs:
        if a != b:
            adj[a].add(b)
            adj[b].add(a)
    return adj


def pieces(nodes, adj, without=None):
    left, out = set(nodes) - {without}, []
    while left:
        seen, todo = set(), [min(left)]
        while todo:
            x = todo.pop()
            if x in seen:
                continue
            seen.add(x)
            todo += [y for y in adj[x] if y != without]
        out.append(seen)
        left -= seen
    return out


def distances(adj, s):
    d, todo = {s: 0}, deque([s])
    while todo:
        x = todo.popleft()
        for y in adj[x]:
            if y not in d:
                d[y] = d[x] + 1
                todo.append(y)
    return d


def directed(pairs):
    adj = defaultdict(set)
    for a, b in pairs:
        if a != b:
            adj[a].add(b)
    return adj


@pytest.mark.parametrize("seed", [1, 2])
def test_components_cores_and_cut_points(spark, seed):
    g, pairs = random_graph(spark, seed, 50, 55)
    adj, nodes = undirected(pairs), range(50)
    want = {x: min(p) for p in pieces(nodes, adj) for x in p}
    assert {r.id: r.component for r in structure.components(g).collect()} == want
    base = len(pieces(nodes, adj))
    cut = {x for x in nodes if adj[x] and len(pieces(nodes, adj, x)) > base}
    assert {r.id for r in structure.articulation_points(g).collect()} == cut
    if seed == 1:
        assert {r.id for r in structure.articulation_points(g, small=0).collect()} == cut
    core, left, k = {}, {x: set(adj[x]) for x in nodes}, 0
    while left:
        x = min(left, key=lambda v: len(left[v]))
        k = max(k, len(left[x]))
        core[x] = k
        for y in left.pop(x):
            left[y].discard(x)
    assert {r.id: r.core for r in structure.core_numbers(g).collect()} == core


@pytest.mark.parametrize("small", [0, 100_000])
def test_strong_components(spark, small):
    g, pairs = random_graph(spark, 3, 30, 60)
    adj = directed(pairs)
    reach = {x: set(distances(adj, x)) for x in range(30)}
    want = {x: min(y for y in reach[x] if x in reach[y]) for x in range(30)}
    assert {r.id: r.component for r in structure.strong_components(g, small=small).collect()} == want


def test_cores_of_a_long_path_and_by_rounds(spark):
    path = make(spark, [(i, "function", f"x{i}") for i in range(500)], [(i, i + 1, "calls") for i in range(499)])
    assert {r.core for r in structure.core_numbers(path).collect()} == {1}  # 250 rounds of h-indexes
    g, _ = random_graph(spark, 5, 40, 80)
    assert {tuple(r) for r in structure.core_numbers(g, small=0).collect()} == {tuple(r) for r in structure.core_numbers(g).collect()}


def test_strong_components_of_a_long_chain(spark):
    """Each of 110 pairs calls all later ones, so that colouring along the links frees only the first."""
    n = 110
    links = [(2 * i + x, 2 * i + 1 - x, "calls") for i in range(n) for x in (0, 1)] + [(2 * i, 2 * j, "calls") for i in range(n) for j in range(i + 1, n)]
    g = make(spark, [(i, "function", f"x{i}") for i in range(2 * n)], links)
    assert {r.id: r.component for r in structure.strong_components(g, small=0).collect()} == {i: i // 2 * 2 for i in range(2 * n)}


@pytest.mark.parametrize("small", [0, 100_000])
def test_betweenness(spark, small):
    g, pairs = random_graph(spark, 4, 25, 50)
    adj = directed(pairs)
    want = defaultdict(float)
    for s in range(6):
        d, flow = distances(adj, s), defaultdict(float)
        for v in sorted(d, key=d.get, reverse=True):
            before = [u for u in d if v in adj[u] and d[u] + 1 == d[v]]
            for u in before:
                flow[u] += (1 + flow[v]) / len(before)
        for v in d:
            if v != s:
                want[v] += flow[v]
    got = {r.id: r.betweenness for r in structure.approx_betweenness(g, 6, small=small).collect()}
    assert all(abs(got[v] - want[v]) < 1e-9 for v in range(25))


def test_reach_counterfactual_and_budget(spark):
    g = make(spark, [(i, "function", n) for i, n in enumerate("abcd")], [(0, 1, "calls"), (1, 2, "calls"), (3, 2, "calls")])
    seed = g.nodes.where("id = 0")
    assert {(r.id, r.depth) for r in traverse.bounded_reach(g, seed, 5, "out").collect()} == {(0, 0), (1, 1), (2, 2)}
    assert {r.id for r in traverse.counterfactual(g, seed).collect()} == {1, 2}
    assert {r.id for r in traverse.counterfactual(g, g.nodes.where("id = 2"), "in").collect()} == {0, 1, 3}
    assert traverse.traverse(g, seed, "both", 3, token_budget=1).count() == 1
    with pytest.raises(ValueError):
        traverse.links(g, "sideways")


def test_paths(spark):
    g = make(spark, [(i, "function", n) for i, n in enumerate("abcde")], [(0, 1, "calls"), (1, 4, "calls"), (0, 2, "imports"), (2, 4, "calls"), (0, 4, "calls", {"conf_class": "inferred"}), (4, 0, "calls"), (0, 1, "calls")])
    start, goal = g.nodes.where("id = 0").select("id"), g.nodes.where("id = 4").select("id")
    found = {tuple(r.path): round(r.cost, 4) for r in traverse.simple_paths(g, start, goal, 4).collect()}
    assert found == {(0, 1, 4): 2.0, (0, 2, 4): 2.35, (0, 4): round(1 / 0.7, 4)}
    assert [tuple(r.path) for r in traverse.top_paths(g, start, goal, 4, 2).orderBy("rank").collect()] == [(0, 4), (0, 1, 4)]
    assert traverse.simple_paths(g, start, goal, 4, min_confidence=1.0).count() == 2
    order = traverse.diversify([([0, 1, 4], 2.0), ([0, 1, 5, 4], 2.05), ([0, 2, 4], 2.1)])
    assert [p for p, _ in order][:1] == [[0, 1, 4]] and len(order) == 3


def test_impact_prefers_the_cheapest_chain(spark):
    g = make(spark, [(i, "function", n) for i, n in enumerate("abcd")], [(1, 0, "calls"), (2, 1, "calls"), (3, 2, "calls"), (2, 0, "imports")])
    hits = {r.id: (round(r.cost, 3), r.distance) for r in traverse.impact(g, g.nodes.where("id = 0").select("id"), 2).collect()}
    assert hits == {1: (1.0, 1), 2: (1.6, 1), 3: (2.6, 2)}


def test_ranks(spark):
    g = make(spark, [(i, "function", n) for i, n in enumerate("abcd")], [(0, 3, "calls"), (1, 3, "calls"), (2, 3, "calls"), (3, 0, "calls", {"conf_class": "ambiguous"})])
    r = {x.id: x.rank for x in centrality.pagerank(g, iterations=20).collect()}
    assert abs(sum(r.values()) - 1) < 1e-9 and max(r, key=r.get) == 3
    p = {x.id: x.rank for x in centrality.pagerank(g, iterations=20, seeds=spark.createDataFrame([(0, 1.0), (1, -2.0)], "id bigint, weight double")).collect()}
    assert p[0] > p[1] and abs(sum(p.values()) - 1) < 1e-9
    assert centrality.pagerank(make(spark, [], []), iterations=2).count() == 0


def test_empty_graph(spark):
    g = make(spark, [], [])
    for f in (structure.components, structure.strong_components, structure.cycles, structure.core_numbers, structure.articulation_points, structure.approx_betweenness):
        assert f(g).count() == 0
    assert structure.call_resolution(g).first().rate == 1.0


def test_graph_changes(spark):
    g = make(spark, [(1, "function", "a"), (2, "function", "b"), (3, "function", "c")], [(1, 2, "calls"), (3, 2, "calls"), (1, 3, "calls"), (1, 2, "calls")])
    merged = g.merge_nodes(spark.createDataFrame([(3, 1)], "loser bigint, winner bigint"))
    assert merged.nodes.count() == 2 and sorted((r.src, r.dst) for r in merged.edges.collect()) == [(1, 2), (1, 2)]
    renamed = g.rename("m::a", "m::z")
    assert renamed.find("m::z").first().name == "z" and g.rename("m::a", "m::b").nodes.count() == 2
    other = make(spark, [(1, "class", "b"), (2, "class", "new")], [(1, 2, "calls"), (2, 2, "calls")])
    both = g.union(other)
    assert {r.qualified_name: r.kind for r in both.nodes.collect()} == {"m::a": "function", "m::b": "function", "m::c": "function", "m::new": "class"}
    assert both.edges.count() == 5
    assert g.add_nodes(other.nodes).nodes.where("qualified_name = 'm::b'").first().kind == "class"
    assert g.add_nodes(other.nodes, keep_existing=True).nodes.where("qualified_name = 'm::b'").first().kind == "function"
    less = g.remove_nodes(g.nodes.where("id = 2"))
    assert less.edges.count() == 1 and less.nodes.count() == 2
    assert g.remove_edges(g.edges.where("edge_id = 0")).edges.count() == 3
    assert g.has_edge_kind("calls").count() == 2 and g.add_edges(g.edges).edges.count() == 8
    assert g.degrees().where(F.col("id") == 2).first().in_degree == 3
