"""Queries over the graph's shape: degrees, hubs, traversal, paths, ranks, components, cores."""

from __future__ import annotations

from pyspark.sql import functions as F

from knotwork.graph import PropertyGraph, graph_sql
from knotwork.operators import centrality, structure, traverse
from knotwork.weights import BOOST, EDGE_WEIGHTS, IMPACT, NODE_WEIGHTS, PATH, RANK, sql_case

G = graph_sql()
#: The seed of single-seed queries: the function with the most outgoing calls, then the least name.
SEED_SQL = """
seed AS (SELECT n.id FROM n JOIN e ON e.src = n.id AND e.kind = 'calls' WHERE n.kind = 'function' GROUP BY n.id, n.qualified_name ORDER BY count(*) DESC, n.qualified_name LIMIT 1)"""


def graph(spark, folder, *extra):
    from knotwork.graph import NODE_COLUMNS

    return PropertyGraph.load(spark, folder, (*NODE_COLUMNS, *extra))


def busy_seed(g):
    calls = g.edges.where("kind = 'calls'").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"))
    return g.nodes.where("kind = 'function'").join(calls, "id").orderBy(F.desc("n"), "qualified_name").limit(1).select("id")


def degree_stats(spark, folder):
    g = graph(spark, folder)
    return g.degrees().join(g.nodes.select("id", "qualified_name"), "id").select("qualified_name", "in_degree", "out_degree", "degree")


def hub_nodes(spark, folder):
    return structure.hub_nodes(graph(spark, folder), 25).drop("id")


def callers(spark, folder):
    """Callers of every node, multi-edges kept."""
    g = graph(spark, folder)
    name = lambda k, to: g.nodes.select(F.col("id").alias(k), F.col("qualified_name").alias(to))
    return traverse.callers_of(g, g.nodes).join(name("target", "target_name"), "target").join(name("caller", "caller_name"), "caller").select("target_name", "caller_name")


def callees(spark, folder):
    g = graph(spark, folder)
    pairs = traverse.callees_of(g, g.nodes).groupBy("source").agg(F.count("*").alias("calls"), F.countDistinct("callee").alias("callees"))
    return pairs.join(g.nodes.select(F.col("id").alias("source"), "qualified_name"), "source").select("qualified_name", "calls", "callees")


def call_resolution(spark, folder):
    return structure.call_resolution(graph(spark, folder))


def graph_counts(spark, folder):
    return graph(spark, folder).counts()


def bfs_reach(spark, folder):
    g = graph(spark, folder)
    return traverse.bounded_reach(g, busy_seed(g), 3, "out").join(g.nodes, "id").select("qualified_name", F.col("depth").cast("int").alias("depth"))


def traverse_budget(spark, folder):
    g = graph(spark, folder)
    return traverse.traverse(g, busy_seed(g)).select("qualified_name", "kind", F.col("depth").cast("int").alias("depth"))


def counterfactual(spark, folder):
    g = graph(spark, folder)
    return traverse.counterfactual(g, busy_seed(g)).join(g.nodes, "id").select("qualified_name", F.col("depth").cast("int").alias("depth"))


def impact(spark, folder):
    g = graph(spark, folder)
    hits = traverse.impact(g, busy_seed(g)).join(g.nodes.select("id", "qualified_name"), "id")
    return hits.select("qualified_name", F.round("score", 6).alias("score"), F.round("cost", 6).alias("cost"))


def _path_ends(g):
    return busy_seed(g), g.nodes.where("kind = 'class'").select("id")


def simple_paths(spark, folder):
    g = graph(spark, folder)
    found = traverse.simple_paths(g, *_path_ends(g), 4, kinds=["calls", "imports", "inherits", "implements", "reads_writes", "member_of"])
    return found.select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), F.round("cost", 6).alias("cost"), F.col("hops").cast("int").alias("hops"))


def top_paths(spark, folder):
    g = graph(spark, folder)
    found = traverse.top_paths(g, *_path_ends(g), 4, 10, kinds=["calls", "imports", "inherits", "implements", "reads_writes", "member_of"])
    return found.select(F.round("cost", 6).alias("cost"), F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


def pagerank(spark, folder):
    g = graph(spark, folder)
    return centrality.pagerank(g).join(g.nodes, "id").select("qualified_name", F.round("rank", 6).alias("rank"))


def personalized_pagerank(spark, folder):
    g = graph(spark, folder)
    r = centrality.pagerank(g, seeds=busy_seed(g).withColumn("weight", F.lit(1.0)))
    return r.join(g.nodes, "id").select("qualified_name", F.round("rank", 6).alias("rank"))


def god_nodes(spark, folder):
    g = graph(spark, folder)
    r = centrality.pagerank(g).join(centrality.without_rank_noise(g.nodes), "id")
    return r.select("qualified_name", "kind", F.round("rank", 6).alias("score")).orderBy(F.desc("score"), "qualified_name").limit(10)


def components(spark, folder):
    return structure.components(graph(spark, folder)).select(F.col("id").alias("node_id"), "component")


def cycles(spark, folder):
    return structure.cycles(graph(spark, folder))


def k_core(spark, folder):
    return structure.core_numbers(graph(spark, folder)).select(F.col("id").alias("node_id"), "core")


def articulation(spark, folder):
    return structure.articulation_points(graph(spark, folder)).select(F.col("id").alias("node_id"))


def betweenness_64(spark, folder):
    b = structure.approx_betweenness(graph(spark, folder))
    return b.where("betweenness > 0").select(F.col("id").alias("node_id"), F.round("betweenness", 6).alias("betweenness"))


def bridge_nodes(spark, folder):
    """Bridge scores over the top folders as communities."""
    g = graph(spark, folder)
    folders = g.nodes.where("source_uri is not null").select("id", F.regexp_extract("source_uri", "^([^/]*)/", 1).alias("community"))
    b = structure.bridge_scores(g, folders)
    return b.select(F.col("id").alias("node_id"), F.round("score", 4).alias("score"), "communities_touched", "degree", F.round("betweenness", 6).alias("betweenness"), F.col("articulation").alias("is_cut"))


def diverse_paths(spark, folder):
    """The cheapest paths from the busiest function to methods, each after the first dearer by what it shares with those before."""
    g = graph(spark, folder)
    best = traverse.top_paths(g, busy_seed(g), g.nodes.where("kind = 'method'").select("id")).collect()  # ten paths
    rows = [(i, ">".join(map(str, path)), round(cost, 6)) for i, (path, cost) in enumerate(traverse.diversify([(r.path, r.cost) for r in best]), 1)]
    return spark.createDataFrame(rows, "rank int, path string, cost double")


QUERIES = {f.__name__: f for f in (degree_stats, hub_nodes, callers, callees, call_resolution, graph_counts, bfs_reach, traverse_budget, counterfactual, impact, simple_paths, top_paths, pagerank, personalized_pagerank, god_nodes, components, cycles, k_core, articulation, betweenness_64, bridge_nodes, diverse_paths)}

_DEGREES = """
d AS (SELECT n.id, n.qualified_name, n.kind, coalesce(i.c, 0) AS in_degree, coalesce(o.c, 0) AS out_degree, coalesce(i.c, 0) + coalesce(o.c, 0) AS degree FROM n
  LEFT JOIN (SELECT dst, count(*) AS c FROM e GROUP BY 1) i ON i.dst = n.id LEFT JOIN (SELECT src, count(*) AS c FROM e GROUP BY 1) o ON o.src = n.id)"""


def _reach(name: str, seed: str, pairs: str, depth: int) -> str:
    return f"{name}_walk(id, depth) AS (SELECT id, 0 FROM {seed} UNION SELECT l.b, w.depth + 1 FROM {name}_walk w JOIN {pairs} l ON l.a = w.id WHERE w.depth < {depth}), {name} AS (SELECT id, min(depth) AS depth FROM {name}_walk GROUP BY id)"


_LINKS = "fwd AS (SELECT DISTINCT src AS a, dst AS b FROM e), und AS (SELECT a, b FROM fwd UNION SELECT b, a FROM fwd)"
_CARD = """ceil(length(json_object('qualified_name', qualified_name, 'kind', kind) || CASE WHEN source_uri IS NULL THEN '' ELSE ',"source_uri":' || to_json(source_uri) END || ',"depth":' || depth) / 4.0)"""
_COST = f"{sql_case('kind', EDGE_WEIGHTS, PATH, 1)} / least(greatest(confidence, 0.05), 1)"
_ENDS = "ends AS (SELECT id AS z FROM n WHERE kind = 'class')"
_PATHS = f"""
step AS (SELECT src, dst, min({_COST}) AS c FROM e WHERE src <> dst AND kind IN ('calls', 'imports', 'inherits', 'implements', 'reads_writes', 'member_of') GROUP BY 1, 2),
walk(path, tail, cost, hops) AS (SELECT [id], id, CAST(0 AS DOUBLE), 0 FROM seed UNION ALL
  SELECT list_append(path, dst), dst, cost + c, hops + 1 FROM walk JOIN step ON src = tail WHERE hops < 4 AND NOT list_contains(path, dst) {{stop}})"""


def _rank_sql(teleport: str, rounds: int = 50) -> str:
    steps = [f"w AS (SELECT src, dst, sum({sql_case('kind', EDGE_WEIGHTS, RANK, 1)} * greatest(confidence, 0.05)) AS w FROM e WHERE conf_class <> 'ambiguous' GROUP BY 1, 2)",
             "s AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS share FROM w)", f"t AS (SELECT id, {teleport} AS teleport FROM n)",
             "r0 AS (SELECT id, 1.0 / (SELECT count(*) FROM n) AS rank FROM n)"]
    for i in range(1, rounds + 1):
        steps.append(f"g{i} AS MATERIALIZED (SELECT s.dst, sum(r.rank * s.share) AS got FROM r{i - 1} r JOIN s ON s.src = r.id GROUP BY 1)")
        steps.append(f"r{i} AS MATERIALIZED (SELECT t.id, t.teleport * (0.15 + 0.85 * (1 - (SELECT sum(got) FROM g{i}))) + 0.85 * coalesce(g.got, 0) AS rank FROM t LEFT JOIN g{i} g ON g.dst = t.id)")
    return f"WITH {G}, {SEED_SQL}, " + ", ".join(steps)


def _core_sql(rounds: int = 40) -> str:
    """h-index rounds, far more than the tables need to settle."""
    steps = ["p AS (SELECT a, b FROM und WHERE a <> b)", "c0 AS (SELECT a AS id, count(*) AS c FROM p GROUP BY 1)"]
    for i in range(1, rounds + 1):
        steps.append(f"""c{i} AS MATERIALIZED (SELECT a AS id, max(least(v, k)) AS c FROM (SELECT p.a, x.c AS v, row_number() OVER (PARTITION BY p.a ORDER BY x.c DESC) AS k
            FROM p JOIN c{i - 1} x ON x.id = p.b) GROUP BY 1)""")
    return f"WITH {G}, {_LINKS}, " + ", ".join(steps) + f" SELECT n.id AS node_id, coalesce(c, 0)::BIGINT AS core FROM n LEFT JOIN c{rounds} c USING (id)"


def _betweenness_sql(value: str = "round(sum(x), 6)", levels: int = 40) -> str:
    """Searches from the 64 least ids over more levels than the tables have, then shares from the deepest level upwards."""
    steps = ["s64 AS (SELECT id AS s FROM n ORDER BY id LIMIT 64)", "fw AS MATERIALIZED (SELECT a, b FROM fwd WHERE a <> b)", "l0 AS MATERIALIZED (SELECT s, s AS id, 0 AS d FROM s64)", "v0 AS (SELECT * FROM l0)"]
    for i in range(1, levels + 1):
        steps.append(f"l{i} AS MATERIALIZED (SELECT DISTINCT s, b AS id, {i} AS d FROM l{i - 1} l JOIN fw ON a = l.id WHERE NOT EXISTS (SELECT 1 FROM v{i - 1} v WHERE v.s = l.s AND v.id = fw.b))")
        steps.append(f"v{i} AS MATERIALIZED (SELECT * FROM v{i - 1} UNION ALL SELECT * FROM l{i})")
    steps.append(f"g AS MATERIALIZED (SELECT x.s, x.id AS a, y.id AS b, y.d, count(*) OVER (PARTITION BY x.s, y.id) AS k FROM v{levels} x JOIN fw ON fw.a = x.id JOIN v{levels} y ON y.s = x.s AND y.id = fw.b AND y.d = x.d + 1)")
    steps.append(f"f{levels} AS (SELECT s, a AS id, sum(1.0::DOUBLE / k) AS x FROM g WHERE d = {levels} GROUP BY 1, 2)")
    for i in range(levels - 1, 0, -1):
        steps.append(f"f{i} AS MATERIALIZED (SELECT g.s, g.a AS id, sum((1.0::DOUBLE + coalesce(f.x, 0)) / k) AS x FROM g LEFT JOIN f{i + 1} f ON f.s = g.s AND f.id = g.b WHERE g.d = {i} GROUP BY 1, 2)")
    whole = " UNION ALL ".join(f"SELECT id, x FROM f{i} WHERE id <> s" for i in range(1, levels + 1))
    return f"WITH {G}, {_LINKS}, " + ", ".join(steps) + f" SELECT id AS node_id, {value} AS betweenness FROM ({whole}) GROUP BY 1"


#: What each node's least neighbour reaches without the node; a neighbour it doesn't reach makes the node a cut point.
_CUTS = """
p AS MATERIALIZED (SELECT a, b FROM und WHERE a <> b), r(v, id) AS (SELECT a, min(b) FROM p GROUP BY 1 HAVING count(*) > 1 UNION SELECT r.v, p.b FROM r JOIN p ON p.a = r.id WHERE p.b <> r.v),
cut AS MATERIALIZED (SELECT DISTINCT p.a AS id FROM p WHERE p.a IN (SELECT v FROM r) AND NOT EXISTS (SELECT 1 FROM r WHERE r.v = p.a AND r.id = p.b))"""

ORACLES = {
    "betweenness_64": _betweenness_sql(),
    "articulation": f"WITH RECURSIVE {G}, {_LINKS}, {_CUTS} SELECT id AS node_id FROM cut",
    "bridge_nodes": f"""WITH RECURSIVE {G}, {_LINKS}, {_DEGREES}, {_CUTS}, bw AS ({_betweenness_sql("sum(x)")}), fo AS (SELECT id, regexp_extract(source_uri, '^([^/]*)/', 1) AS c FROM n WHERE source_uri IS NOT NULL),
        tc AS (SELECT a AS id, count(DISTINCT c) AS k FROM und JOIN fo ON fo.id = und.b GROUP BY 1),
        j AS (SELECT d.id, coalesce(k, 0) AS k, d.degree, coalesce(betweenness, 0) AS w, d.id IN (SELECT id FROM cut) AS is_cut FROM d LEFT JOIN tc USING (id) LEFT JOIN bw ON bw.node_id = d.id)
        SELECT id AS node_id, round(3.0 * k + degree + sqrt(w) + CASE WHEN is_cut THEN 12 ELSE 0 END, 4) AS score, k AS communities_touched, degree, round(w, 6) AS betweenness, is_cut FROM j WHERE k + degree + w > 0 OR is_cut""",
    "degree_stats": f"WITH {G}, {_DEGREES} SELECT qualified_name, in_degree, out_degree, degree FROM d",
    "hub_nodes": f"WITH {G}, {_DEGREES} SELECT qualified_name, kind, in_degree, out_degree, degree FROM d WHERE degree > 0 AND kind <> 'file' ORDER BY degree DESC, qualified_name LIMIT 25",
    "callers": f"WITH {G} SELECT t.qualified_name AS target_name, s.qualified_name AS caller_name FROM e JOIN n s ON s.id = src JOIN n t ON t.id = dst WHERE e.kind = 'calls'",
    "callees": f"WITH {G} SELECT qualified_name, count(*) AS calls, count(DISTINCT dst) AS callees FROM e JOIN n ON n.id = src WHERE e.kind = 'calls' GROUP BY n.id, qualified_name",
    "call_resolution": f"WITH {G} SELECT sum((qualified_name NOT LIKE 'call::%')::BIGINT)::BIGINT AS resolved, sum((qualified_name LIKE 'call::%')::BIGINT)::BIGINT AS unresolved, avg((qualified_name NOT LIKE 'call::%')::INT) AS rate FROM e JOIN n ON n.id = dst WHERE e.kind = 'calls'",
    "graph_counts": f"WITH {G} SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM e) AS edges",
    "bfs_reach": f"WITH RECURSIVE {G}, {SEED_SQL}, {_LINKS}, {_reach('hit', 'seed', 'fwd', 3)} SELECT qualified_name, depth FROM hit JOIN n USING (id)",
    "traverse_budget": f"""WITH RECURSIVE {G}, {SEED_SQL}, {_LINKS}, {_reach('hit', 'seed', 'und', 3)},
        priced AS (SELECT qualified_name, kind, depth, {_CARD} AS tokens FROM hit JOIN n USING (id)),
        summed AS (SELECT *, sum(tokens) OVER (ORDER BY depth, qualified_name) - tokens AS before FROM priced) SELECT qualified_name, kind, depth FROM summed WHERE before < 1200""",
    "counterfactual": f"""WITH RECURSIVE {G}, {SEED_SQL}, {_LINKS}, cut AS (SELECT a, b FROM fwd WHERE a NOT IN (SELECT id FROM seed)),
        {_reach('hit', 'seed', 'fwd', 5)}, {_reach('aft', 'seed', 'cut', 5)} SELECT qualified_name, depth FROM hit JOIN n USING (id) WHERE id NOT IN (SELECT id FROM aft)""",
    "impact": f"""WITH RECURSIVE {G}, {SEED_SQL}, back AS (SELECT dst AS a, src AS b, min({sql_case('kind', EDGE_WEIGHTS, IMPACT, 1)} / least(greatest(confidence, 0.05), 1)) AS c FROM e WHERE src <> dst GROUP BY 1, 2),
        h1 AS (SELECT b AS id, min(c) AS cost FROM back WHERE a IN (SELECT id FROM seed) GROUP BY 1), {", ".join(f"h{i + 1} AS MATERIALIZED (SELECT b.b AS id, min(h.cost + b.c) AS cost FROM h{i} h JOIN back b ON b.a = h.id GROUP BY 1)" for i in (1, 2, 3))},
        best AS (SELECT id, min(cost) AS cost FROM ({" UNION ALL ".join(f"SELECT * FROM h{i}" for i in (1, 2, 3, 4))}) WHERE id NOT IN (SELECT id FROM seed) GROUP BY 1)
        SELECT qualified_name, round({sql_case('kind', NODE_WEIGHTS, BOOST, 0.7)} / (1 + cost), 6) AS score, round(cost, 6) AS cost FROM best JOIN n USING (id)""",
    "simple_paths": f"WITH RECURSIVE {G}, {SEED_SQL}, {_ENDS}, {_PATHS.format(stop='')} SELECT array_to_string(path, '>') AS path, round(cost, 6) AS cost, hops FROM walk JOIN ends ON tail = z WHERE hops > 0",
    "top_paths": f"""WITH RECURSIVE {G}, {SEED_SQL}, {_ENDS}, {_PATHS.format(stop='AND tail NOT IN (SELECT z FROM ends)')}
        SELECT round(cost, 6) AS cost, array_to_string(path, '>') AS path FROM walk JOIN ends ON tail = z WHERE hops > 0 ORDER BY walk.cost, hops, walk.path LIMIT 10""",
    "pagerank": f"{_rank_sql('1.0 / (SELECT count(*) FROM n)')} SELECT qualified_name, round(rank, 6) AS rank FROM r50 JOIN n USING (id)",
    "personalized_pagerank": f"{_rank_sql('CASE WHEN id IN (SELECT id FROM seed) THEN 1.0 ELSE 0.0 END')} SELECT qualified_name, round(rank, 6) AS rank FROM r50 JOIN n USING (id)",
    "god_nodes": f"""{_rank_sql('1.0 / (SELECT count(*) FROM n)')} SELECT qualified_name, kind, round(rank, 6) AS score FROM r50 JOIN n USING (id)
        WHERE kind NOT IN ('file', 'flow', 'hyperedge') AND qualified_name NOT LIKE 'call::%' ORDER BY score DESC, qualified_name LIMIT 10""",
    "cycles": f"""WITH RECURSIVE {G}, {_LINKS}, t1 AS (SELECT * FROM fwd WHERE a <> b AND a IN (SELECT b FROM fwd) AND b IN (SELECT a FROM fwd)),
        t2 AS (SELECT * FROM t1 WHERE a IN (SELECT b FROM t1) AND b IN (SELECT a FROM t1)), t3 AS (SELECT * FROM t2 WHERE a IN (SELECT b FROM t2) AND b IN (SELECT a FROM t2)),
        c(a, b) AS (SELECT a, b FROM t3 UNION SELECT c.a, t3.b FROM c JOIN t3 ON t3.a = c.b), m AS (SELECT x.a AS id, least(x.a, min(x.b)) AS component FROM c x JOIN c y ON y.a = x.b AND y.b = x.a GROUP BY x.a)
        SELECT component, count(*) AS size FROM m GROUP BY 1 HAVING count(*) > 1
        UNION ALL SELECT src, 1 FROM (SELECT DISTINCT src FROM e WHERE src = dst) WHERE src NOT IN (SELECT id FROM m GROUP BY component, id HAVING (SELECT count(*) FROM m m2 WHERE m2.component = m.component) > 1)""",
    "k_core": _core_sql(),
    "components": f"""WITH RECURSIVE {G}, {_LINKS}, c(id, m) USING KEY (id) AS (SELECT id, id FROM n UNION
        SELECT und.b, min(c.m) FROM c JOIN und ON und.a = c.id JOIN recurring.c o ON o.id = und.b WHERE c.m < o.m GROUP BY 1) SELECT id AS node_id, m AS component FROM c""",
}
