"""Queries over code graphs: communities, flows, dead code, review, history, enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from knotwork.functions.names import DOC_LANGUAGES, identifier_words_sql, language_sql
from knotwork.graph import EDGE_COLUMNS, NODE_COLUMNS, PropertyGraph, graph_sql
from knotwork.operators import communities as comm
from knotwork.operators import enrich, flows, refactor, review, temporal
from knotwork.plans.structure import G, graph
from knotwork.session import read_table, stage
from knotwork.weights import AMBIGUOUS_COMMUNITY_WEIGHT, COMMUNITY, EDGE_WEIGHTS, NODE_WEIGHTS, SPECIFICITY, sql_case


def by_folder(g):
    """(id, community): the top folder of each node's source; nodes without one are left out."""
    return g.nodes.where("source_uri is not null").select("id", F.regexp_extract("source_uri", "^([^/]*)/", 1).alias("community"))


def large_functions(spark, folder):
    return refactor.large_functions(graph(spark, folder), 40)


def gaps(spark, folder):
    return refactor.gaps(graph(spark, folder))


def dead_code(spark, folder):
    return refactor.dead_code(graph(spark, folder)).drop("id")


def rename_preview(spark, folder):
    g = graph(spark, folder)
    called = g.edges.where("kind = 'calls'").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"))
    target = g.nodes.where("kind = 'method'").join(called, "id").orderBy(F.desc("n"), "qualified_name").select("qualified_name").first()
    return refactor.rename_preview(g, target.qualified_name if target else "", "renamed_symbol")


def confidence_mix(spark, folder):
    return refactor.confidence_mix(graph(spark, folder))


def graph_summary(spark, folder):
    return refactor.graph_summary(graph(spark, folder))


def surprises(spark, folder):
    g = graph(spark, folder)
    return refactor.surprises(g, by_folder(g)).withColumn("score", F.round("score", 6))


def coupling(spark, folder):
    g = graph(spark, folder)
    return refactor.coupling(g, by_folder(g))


def architecture(spark, folder):
    g = graph(spark, folder)
    a = refactor.architecture(g, by_folder(g))
    return a.select("community", "size", F.array_join("files", "|").alias("files"))


def cohesion(spark, folder):
    g = graph(spark, folder)
    return comm.cohesion(g, by_folder(g)).withColumn("cohesion", F.round("cohesion", 6))


def conductance(spark, folder):
    g = graph(spark, folder)
    return comm.conductance(g, by_folder(g)).withColumn("conductance", F.round("conductance", 6))


def community_quality(spark, folder):
    g = graph(spark, folder)
    q = comm.quality(g, by_folder(g))
    return q.select("communities", "largest", "low_cohesion", *[F.round(c, 6).alias(c) for c in ("mean_size", "size_score", "max_conductance")])


def modularity(spark, folder):
    g = graph(spark, folder)
    return comm.modularity(g, by_folder(g)).select(F.round("modularity", 6).alias("modularity"))


def knowledge_gaps(spark, folder):
    g = graph(spark, folder)
    return comm.knowledge_gaps(g, by_folder(g))


def _detected(name):
    def run(spark, folder):
        g = graph(spark, folder)
        return comm.detect(g, name).join(g.nodes.select("id", "qualified_name"), "id").select("qualified_name", "community")

    run.__name__ = name
    run.__doc__ = f"Communities by {name}; unique only up to ties, so tests check invariants."
    return run


def _checked(name):
    def run(spark, folder):
        g = graph(spark, folder)
        found = stage(comm.detect(g, name), "checked")
        links = comm.weighted_links(g).select("a", "b")
        pieces = comm.enforce_connected(found, links).withColumnRenamed("community", "piece")
        one = found.join(pieces, "id").agg(F.count("*").alias("rows"), F.countDistinct("id").alias("nodes"), F.sum((F.col("community") != F.col("piece")).cast("bigint")).alias("apart"))
        lone = g.nodes.select("id").join(links.select(F.col("a").alias("id")), "id", "left_anti").join(found.where("id = community"), "id", "left_anti")
        singles = g.nodes.select("id", F.col("id").alias("community"))
        better = comm.modularity(g, found).select(F.col("modularity").alias("x")).crossJoin(comm.modularity(g, singles).select(F.col("modularity").alias("y")))  # one row each
        return one.select("rows", "nodes", "apart", lone.agg(F.count("*")).scalar().alias("lone_elsewhere"), better.select(F.col("x") > F.col("y")).scalar().alias("better"))

    run.__name__ = f"{name}_invariants"
    run.__doc__ = f"Of {name}: every node once, communities connected and named by a member, lone nodes alone, better than single nodes."
    return run


def community_split(spark, folder):
    return comm.split_oversized(graph(spark, folder)).withColumnRenamed("id", "node_id")


def community_listing(spark, folder):
    g = graph(spark, folder)
    c = comm.listing(g, by_folder(g))
    return c.select("community", "size", F.array_join("members", "|").alias("members"))


def entry_points(spark, folder):
    g = graph(spark, folder)
    return flows.entry_points(g).join(g.nodes.select("id", "qualified_name"), "id").select("qualified_name", "is_test")


def flow_trace(spark, folder):
    return flows.trace(graph(spark, folder)).select("flow_id", "node_id", F.col("depth").cast("int").alias("depth"))


def flow_criticality(spark, folder):
    g = graph(spark, folder)
    return flows.flows(g, flows.trace(g)).select("flow_id", "entry_name", "size", F.col("depth").cast("int").alias("depth"), F.round("criticality", 6).alias("criticality"), "is_test_flow")


def affected_flows(spark, folder):
    """Flows with a member in a test path."""
    g = graph(spark, folder)
    members = flows.trace(g)
    return flows.affected_flows(members, flows.flows(g, members), g.nodes.where("is_test").select("id")).select("flow_id", "size")


def tested_by(spark, folder):
    return enrich.tested_by(graph(spark, folder))


def test_coverage(spark, folder):
    g = graph(spark, folder)
    return review.test_coverage(g, g.nodes).select("qualified_name", "covered")


def call_tiers(spark, folder):
    g = PropertyGraph.load(spark, folder, (*NODE_COLUMNS, "source_text"), (*EDGE_COLUMNS, "call_scope", "call_receiver"))
    return enrich.resolve_calls(g).select("edge_id", "candidate", "resolved_from")


def mentions_resolve(spark, folder):
    g = graph(spark, folder, "properties")
    return enrich.resolve_mentions(enrich.pending_mentions(g.nodes), g).withColumn("confidence", F.round("confidence", 6))


#: Two commits of the linear history, by position.
BASE, HEAD = 100, 300


def _commit(spark, folder, position):
    row = read_table(spark, folder, "commits").where(F.col("ord") == position).first()
    return row.sha if row else ""


def active_at(spark, folder):
    g = graph(spark, folder, "valid_from", "valid_to")
    return temporal.active_at(g.nodes, read_table(spark, folder, "commits"), _commit(spark, folder, HEAD)).select("qualified_name", "kind")


def temporal_diff(spark, folder):
    g = PropertyGraph.load(spark, folder, ("valid_from", "valid_to"), (*EDGE_COLUMNS, "valid_from", "valid_to"))
    commits, ends = read_table(spark, folder, "commits"), (_commit(spark, folder, BASE), _commit(spark, folder, HEAD))
    n = temporal.temporal_diff(g.nodes, commits, *ends, "id").select(F.lit("node").alias("what"), F.col("id").alias("key"), "change")
    return n.unionByName(temporal.temporal_diff(g.edges, commits, *ends, "edge_id").select(F.lit("edge").alias("what"), F.col("edge_id").alias("key"), "change"))


def hunk_to_nodes(spark, folder):
    """Hunks of five lines at the start of every class."""
    g = graph(spark, folder)
    hunks = g.nodes.where("kind = 'class' and source_uri is not null and line_start is not null").select(F.col("source_uri").alias("path"), F.col("line_start").alias("new_start"), F.lit(5).alias("new_count")).distinct()
    return review.nodes_of_hunks(g.nodes, hunks).select("path", "new_start", F.col("id").alias("node_id"), "specificity")


def changed_ranges(spark, folder):
    """Names at the hunks of hunk_to_nodes, whose paths come with a folder before them."""
    g = graph(spark, folder)
    hunks = g.nodes.where("kind = 'class' and source_uri is not null and line_start is not null").select(F.concat(F.lit("work/"), "source_uri").alias("path"), F.col("line_start").alias("new_start"), F.lit(5).alias("new_count")).distinct()
    return review.changed_ranges(g.nodes, hunks).select("path", "new_start", F.array_join("symbols", "|").alias("symbols"))


def risk_score(spark, folder):
    """Risk of changing each function or method alone: its degree, missing test and callers."""
    g = graph(spark, folder)
    cover = review.test_coverage(g, g.nodes).join(g.degrees(), "id")
    score = review.risk(F.lit(1), F.col("in_degree"), F.col("degree"), F.when(F.col("covered"), 0).otherwise(1), F.lit(0.0))
    return cover.select("qualified_name", F.round(score, 6).alias("risk_score"), review.risk_level(score).alias("risk"))


QUERIES = {f.__name__: f for f in (large_functions, gaps, dead_code, rename_preview, confidence_mix, graph_summary, surprises, coupling, architecture, cohesion, conductance, community_quality, modularity, knowledge_gaps, _detected("louvain"), _detected("leiden"), _detected("infomap"), _checked("louvain"), _checked("leiden"), _checked("infomap"), community_split, community_listing, entry_points, flow_trace, flow_criticality, affected_flows, tested_by, test_coverage, call_tiers, mentions_resolve, active_at, temporal_diff, hunk_to_nodes, changed_ranges, risk_score)}

_D = "d AS (SELECT n.*, coalesce(i.c, 0) AS ind, coalesce(o.c, 0) AS outd, coalesce(i.c, 0) + coalesce(o.c, 0) AS deg FROM n LEFT JOIN (SELECT dst, count(*) AS c FROM e GROUP BY 1) i ON i.dst = n.id LEFT JOIN (SELECT src, count(*) AS c FROM e GROUP BY 1) o ON o.src = n.id)"
_C = "c AS (SELECT id, regexp_extract(source_uri, '^([^/]*)/', 1) AS community FROM n WHERE source_uri IS NOT NULL)"
_X = f"{G}, {_C}, x AS (SELECT e.*, a.community AS ca, b.community AS cb FROM e JOIN c a ON a.id = src JOIN c b ON b.id = dst)"
_SPAN = "(line_end - line_start + 1)"
_COHESION = """sz AS (SELECT community, count(*) AS size FROM c GROUP BY 1), pr AS (SELECT DISTINCT least(src, dst), greatest(src, dst), ca FROM x WHERE src <> dst AND ca = cb),
    co AS (SELECT sz.community, size, CASE WHEN size < 2 THEN 1 ELSE coalesce(k, 0) / (size * (size - 1) / 2.0) END AS cohesion FROM sz LEFT JOIN (SELECT ca, count(*) AS k FROM pr GROUP BY 1) p ON p.ca = sz.community)"""
_CONDUCTANCE = """cd AS (SELECT community, sum(i)::BIGINT AS inner_edges, sum(o)::BIGINT AS outer_edges FROM (SELECT ca AS community, (ca = cb)::INT AS i, (ca <> cb)::INT AS o FROM x UNION ALL SELECT cb, 0, 1 FROM x WHERE ca <> cb) GROUP BY 1)"""
_FLOWS = """
ent AS (SELECT id, name, coalesce(is_test, false) AS t FROM n WHERE kind IN ('function', 'method') AND qualified_name NOT LIKE 'call::%' AND (coalesce(is_test, false) OR coalesce(lower(name) IN ('main', '__main__'), false) OR id NOT IN (SELECT dst FROM e WHERE kind = 'calls'))),
cl AS (SELECT DISTINCT src AS a, dst AS b FROM e WHERE kind = 'calls' AND conf_class <> 'ambiguous' AND dst IN (SELECT id FROM n WHERE qualified_name NOT LIKE 'call::%')),
wk(f, id, depth) AS (SELECT id, id, 0 FROM ent UNION SELECT f, b, depth + 1 FROM wk JOIN cl ON a = wk.id WHERE depth < 6),
fi AS (SELECT dst AS id, count(*) AS k FROM e WHERE kind = 'calls' GROUP BY 1),
m0 AS (SELECT f, id, depth FROM (SELECT *, row_number() OVER (PARTITION BY f ORDER BY depth, id) AS r FROM (SELECT f, id, min(depth) AS depth FROM wk GROUP BY 1, 2)) WHERE r <= 2000),
ci AS (SELECT m.f, m.id, count(*) AS c FROM m0 m JOIN e ON e.dst = m.id AND e.kind = 'calls' JOIN m0 s ON s.f = m.f AND s.id = e.src GROUP BY 1, 2),
mb AS (SELECT m0.f, m0.id, depth, coalesce(k, 0) AS k, row_number() OVER (PARTITION BY m0.f ORDER BY 1.0 / (depth + 1) + least(0.5, coalesce(c, 0) / 10) DESC, depth, m0.id) AS r FROM m0 LEFT JOIN fi ON fi.id = m0.id LEFT JOIN ci ON ci.f = m0.f AND ci.id = m0.id),
fl AS (SELECT f AS flow_id, n.name AS entry_name, count(*) AS size, max(depth) AS depth, least(0.6, ln(count(*)) / 6) + least(0.25, avg(k) / 8)
  + CASE WHEN lower(n.name) IN ('main', '__main__') THEN 0.1 WHEN regexp_matches(lower(n.name), '^(handle|on_|serve)') THEN 0.05 ELSE 0 END - CASE WHEN coalesce(n.is_test, false) THEN 0.2 ELSE 0 END AS s, coalesce(n.is_test, false) AS is_test_flow
  FROM mb JOIN n ON n.id = f WHERE r <= 200 GROUP BY f, n.name, n.is_test HAVING count(*) >= 3)"""
_GV = graph_sql((*NODE_COLUMNS, "valid_from", "valid_to"))
_GT = graph_sql(("valid_from", "valid_to"), (*EDGE_COLUMNS, "valid_from", "valid_to"))


def _active(table: str, key: str, position: int) -> str:
    return f"""(SELECT {key} FROM {table} LEFT JOIN commits f ON f.sha = valid_from LEFT JOIN commits t ON t.sha = valid_to
        WHERE coalesce(valid_from IS NULL OR f.ord <= {position}, false) AND NOT coalesce(t.ord < {position}, false))"""


def _diff(what: str, table: str, key: str) -> str:
    b, h = _active(table, key, BASE), _active(table, key, HEAD)
    return f"SELECT '{what}' AS what, {key} AS key, 'added' AS change FROM (SELECT * FROM {h} EXCEPT SELECT * FROM {b}) UNION ALL SELECT '{what}', {key}, 'removed' FROM (SELECT * FROM {b} EXCEPT SELECT * FROM {h})"


_GP = graph_sql((*NODE_COLUMNS, "properties"))
_GC = graph_sql((*NODE_COLUMNS, "source_text"), (*EDGE_COLUMNS, "call_scope", "call_receiver"))
_MENTIONABLE = ", ".join(f"'{k}'" for k in enrich.MENTIONABLE)
_CALLABLE = ", ".join(f"'{k}'" for k in enrich.CALLABLE)


def _snake(column: str) -> str:
    return f"replace({identifier_words_sql(column)}, ' ', '_')"


def _impl(column: str) -> str:
    part = f"list_extract(string_split({column}, '::'), -2)"
    return f"(CASE WHEN NOT regexp_matches({part}, '[/.]') THEN {part} END)"


def _let(tail: str) -> str:
    return f"nullif(regexp_extract(ft, '(?:let|const|var)\\s+(?:mut\\s+)?' || v || '{tail}', 1), '')"


_NAMED = "CASE lower(r) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in enrich.NAMED_TYPES.items()) + " END"
_TIERS = {
    "unique": "true",
    "same_file": "ff = tf",
    "scope": "scoped",
    "scope_prefix": "scoped AND common = best_common AND common > 0",
    "receiver": f"{_impl('tq')} = rt",
    "import": "imported",
    "same_dir": "regexp_extract(ff, '^(.*)/[^/]*$', 1) = regexp_extract(tf, '^(.*)/[^/]*$', 1)",
    "frequency": "heat = best_heat AND heat > 0",
}
_CALL_TIERS = f"""
o AS (SELECT e.edge_id, e.call_scope AS sc, e.call_receiver AS r, regexp_replace(e.call_receiver, '\\W', '', 'g') AS v, substr(d.qualified_name, 7) AS callee, s.qualified_name AS fq, s.source_uri AS ff, s.source_text AS ft
  FROM e JOIN n d ON d.id = e.dst JOIN n s ON s.id = e.src WHERE e.kind = 'calls' AND d.qualified_name LIKE 'call::%'),
t AS (SELECT id, name, qualified_name AS tq, source_uri AS tf, lower(regexp_replace(regexp_extract(source_uri, '([^/]*)$', 1), '(.)\\.[^.]*$', '\\1')) AS stem FROM n WHERE kind IN ({_CALLABLE}) AND qualified_name NOT LIKE 'call::%'),
im AS (SELECT DISTINCT file, stem FROM (SELECT s.source_uri AS file, unnest(string_split_regex(lower(d.qualified_name), '[^a-z0-9_]+')) AS stem FROM e JOIN n s ON s.id = src JOIN n d ON d.id = dst WHERE e.kind = 'imports') WHERE file IS NOT NULL AND stem <> ''),
ht AS (SELECT dst, count(*) AS heat FROM e WHERE kind = 'calls' GROUP BY 1),
j AS (SELECT o.*, t.*, ht.heat, im.stem IS NOT NULL AS imported, coalesce(sc IS NOT NULL AND contains(tq, sc), false) AS scoped,
  CASE WHEN r = 'self' THEN {_impl('fq')} ELSE coalesce({_let(r'\s*:\s*&?(?:mut\s+)?([A-Z]\w*)')}, {_let(r'\s*=\s*(?:new\s+)?([A-Z]\w*)::')}, {_let(r'\s*=\s*(?:new\s+)?([A-Z]\w*)\s*[({{]')}, {_NAMED}) END AS rt
  FROM o JOIN t ON t.name = o.callee LEFT JOIN im ON im.file = ff AND im.stem = t.stem LEFT JOIN ht ON ht.dst = t.id),
k AS (SELECT *, CASE WHEN scoped THEN len(list_filter(range(1, len(string_split(tq, '::')) + 1), lambda i: list_slice(string_split(tq, '::'), 1, i) = list_slice(string_split(fq, '::'), 1, i))) END AS common FROM j),
b AS (SELECT *, max(common) OVER (PARTITION BY edge_id) AS best_common, max(heat) OVER (PARTITION BY edge_id) AS best_heat FROM k),
h AS (SELECT edge_id, id, {", ".join(f"coalesce({c}, false) AS h{i}" for i, c in enumerate(_TIERS.values()))} FROM b),
w AS ({" UNION ALL ".join(f"SELECT edge_id, {i} AS tier, '{tag}' AS tag, any_value(id) FILTER (h{i}) AS candidate FROM h GROUP BY 1 HAVING count(*) FILTER (h{i}) = 1" for i, tag in enumerate(_TIERS))})
SELECT edge_id, arg_min(candidate, tier) AS candidate, arg_min(tag, tier) AS resolved_from FROM w GROUP BY 1"""

_WEIGHT = f"CASE WHEN conf_class = 'ambiguous' THEN {AMBIGUOUS_COMMUNITY_WEIGHT} ELSE {sql_case('kind', EDGE_WEIGHTS, COMMUNITY, 1)} END"
_DOCS = ", ".join(f"'{x}'" for x in DOC_LANGUAGES)

_INVARIANTS = f"WITH {G} SELECT count(*) AS rows, count(DISTINCT id) AS nodes, 0::BIGINT AS apart, 0::BIGINT AS lone_elsewhere, true AS better FROM n"

ORACLES = {
    "louvain_invariants": _INVARIANTS,
    "leiden_invariants": _INVARIANTS,
    "infomap_invariants": _INVARIANTS,
    "large_functions": f"WITH {G} SELECT qualified_name, kind, source_uri, {_SPAN} AS lines FROM n WHERE kind IN ('function', 'method', 'class', 'trait') AND {_SPAN} >= 40",
    "gaps": f"""WITH {G}, {_D} SELECT * FROM (SELECT qualified_name, CASE WHEN qualified_name LIKE 'call::%' THEN CASE WHEN ind > 0 THEN 'unresolved_call' END
        WHEN kind IN ('function', 'method', 'class', 'type', 'trait') THEN CASE WHEN deg = 0 THEN 'orphan_symbol' WHEN outd = 0 AND {_SPAN} > 40 THEN 'large_leaf' END END AS gap FROM d) WHERE gap IS NOT NULL""",
    "dead_code": f"""WITH {G}, alive AS (SELECT dst AS id FROM e WHERE kind IN ('calls', 'tested_by', 'imports', 'inherits', 'implements') UNION SELECT src FROM e WHERE kind IN ('calls', 'tested_by'))
        SELECT qualified_name, name, kind, source_uri, line_start, line_end FROM n WHERE kind IN ('function', 'method', 'class') AND qualified_name NOT LIKE 'call::%' AND id NOT IN (SELECT id FROM alive)
        AND NOT coalesce(regexp_matches(name, '{refactor.LIVE_NAME}'), false) AND NOT coalesce(regexp_matches(lower(source_uri), '{refactor.LIVE_PATH}'), false)""",
    "rename_preview": f"""WITH {G}, t AS (SELECT n.id, n.name, n.source_uri, n.line_start FROM n JOIN e ON e.dst = n.id AND e.kind = 'calls' WHERE n.kind = 'method' GROUP BY n.id, n.name, n.source_uri, n.line_start, n.qualified_name ORDER BY count(*) DESC, n.qualified_name LIMIT 1),
        s AS (SELECT t.name AS old, t.source_uri, t.line_start, 0 AS o, 'high' AS confidence FROM t
          UNION ALL SELECT t.name, n.source_uri, n.line_start, CASE e.kind WHEN 'calls' THEN 1 ELSE 2 END, 'high' FROM t JOIN e ON e.dst = t.id AND e.kind IN ('calls', 'imports') JOIN n ON n.id = e.src
          UNION ALL SELECT t.name, n.source_uri, n.line_start, 3, 'medium' FROM t JOIN e ON e.src = t.id JOIN n ON n.id = e.dst WHERE contains(n.name, t.name) AND NOT contains(n.qualified_name, 'renamed_symbol'))
        SELECT source_uri AS file, line_start AS line, any_value(old) AS old, 'renamed_symbol' AS new, arg_min(confidence, o) AS confidence FROM s WHERE source_uri IS NOT NULL GROUP BY 1, 2""",
    "confidence_mix": f"WITH {G} SELECT conf_class, count(*) AS edges, round(avg(confidence), 6) AS mean_confidence FROM e GROUP BY 1",
    "graph_summary": f"WITH {G} SELECT 'node_kind' AS what, kind AS key, count(*) AS n FROM n WHERE kind IS NOT NULL GROUP BY 2 UNION ALL SELECT 'edge_kind', kind, count(*) FROM e WHERE kind IS NOT NULL GROUP BY 2 UNION ALL SELECT 'source', source_uri, count(*) FROM n WHERE source_uri IS NOT NULL GROUP BY 2",
    "surprises": f"""WITH {G}, {_D}, {_C}, th AS (SELECT greatest(4, deg) AS t FROM (SELECT deg, row_number() OVER (ORDER BY deg) AS r FROM d) WHERE r = (SELECT CAST(floor(0.9 * count(*)) AS BIGINT) + 1 FROM d)),
        p AS (SELECT edge_id, e.kind, conf_class, a.qualified_name AS qa, b.qualified_name AS qb, {language_sql('a.source_uri')} AS la, {language_sql('b.source_uri')} AS lb, a.deg AS da, b.deg AS db, x.community AS ca, y.community AS cb
          FROM e JOIN d a ON a.id = src JOIN d b ON b.id = dst LEFT JOIN c x ON x.id = src LEFT JOIN c y ON y.id = dst),
        s AS (SELECT *, coalesce(la <> lb, false) AS cl, coalesce(ca <> cb, false) AS cc FROM p WHERE qa NOT LIKE 'call::%' AND qb NOT LIKE 'call::%')
        SELECT * FROM (SELECT edge_id, round(CASE WHEN cc THEN 1 ELSE 0 END + CASE WHEN cl THEN 1.5 ELSE 0 END + CASE WHEN da >= t AND db >= t THEN 1 + least(3, (da + db) / (2.0 * t)) ELSE 0 END, 6) AS score, cc AS cross_community, cl AS cross_language
          FROM s, th WHERE NOT (cl AND kind = 'calls' AND conf_class = 'inferred') AND NOT coalesce(cl AND kind = 'calls' AND lb IN ({_DOCS}) AND la NOT IN ({_DOCS}), false)) WHERE score > 0""",
    "coupling": f"WITH {_X} SELECT least(ca, cb) AS low, greatest(ca, cb) AS high, count(*) AS edges FROM x WHERE ca <> cb GROUP BY 1, 2",
    "architecture": f"""WITH {G}, {_C}, f AS (SELECT community, source_uri, count(*) AS k FROM c JOIN n USING (id) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY k DESC, source_uri) AS r FROM f)
        SELECT community, (SELECT count(*) FROM c WHERE c.community = r.community) AS size, string_agg(source_uri, '|' ORDER BY r) AS files FROM r WHERE r <= 5 GROUP BY community""",
    "cohesion": f"WITH {_X}, {_COHESION} SELECT community, size, round(cohesion, 6) AS cohesion FROM co",
    "conductance": f"WITH {_X}, {_CONDUCTANCE} SELECT community, inner_edges, outer_edges, round(outer_edges / (inner_edges + outer_edges), 6) AS conductance FROM cd",
    "community_quality": f"""WITH {_X}, {_COHESION}, {_CONDUCTANCE} SELECT count(*) AS communities, max(size) AS largest, round(avg(size), 6) AS mean_size, round(sqrt(sum(size * size) / (sum(size) * sum(size))), 6) AS size_score,
        round(coalesce(max(outer_edges / (inner_edges + outer_edges)), 0), 6) AS max_conductance, sum((cohesion < 0.15)::INT)::BIGINT AS low_cohesion FROM co LEFT JOIN cd USING (community)""",
    "modularity": f"""WITH {_X}, w AS (SELECT ca, cb, {_WEIGHT} AS w FROM x UNION ALL SELECT cb, ca, {_WEIGHT} FROM x), t AS (SELECT ca, sum(w) AS k, sum(CASE WHEN ca = cb THEN w ELSE 0 END) AS i FROM w GROUP BY 1)
        SELECT round(sum(i / m - (k / m) * (k / m)), 6) AS modularity FROM t, (SELECT sum(k) AS m FROM t)""",
    "knowledge_gaps": f"""WITH {G}, {_D}, {_C}, g AS (SELECT community, count(*) AS size, min(source_uri) AS lo, max(source_uri) AS hi FROM c JOIN n USING (id) GROUP BY 1)
        SELECT 'isolated' AS gap, qualified_name AS key FROM d WHERE deg <= 1 AND kind <> 'file'
        UNION ALL SELECT 'untested_hotspot', qualified_name FROM d WHERE kind IN ('function', 'method', 'class') AND NOT coalesce(is_test, false) AND deg >= 5 AND id NOT IN (SELECT src FROM e WHERE kind = 'tested_by')
        UNION ALL SELECT 'thin_community', community FROM g WHERE size < 3 UNION ALL SELECT 'single_file', community FROM g WHERE size >= 3 AND lo = hi""",
    "community_listing": f"""WITH {G}, {_C}, r AS (SELECT community, qualified_name, row_number() OVER (PARTITION BY community ORDER BY qualified_name) AS r FROM c JOIN n USING (id))
        SELECT community, count(*) AS size, string_agg(qualified_name, '|' ORDER BY r) FILTER (r <= 5) AS members FROM r GROUP BY 1""",
    "entry_points": f"WITH RECURSIVE {G}, {_FLOWS} SELECT qualified_name, t AS is_test FROM ent JOIN n USING (id)",
    "flow_trace": f"WITH RECURSIVE {G}, {_FLOWS} SELECT f AS flow_id, id AS node_id, depth FROM mb WHERE r <= 200",
    "flow_criticality": f"WITH RECURSIVE {G}, {_FLOWS} SELECT flow_id, entry_name, size, depth, round(least(greatest(s, 0), 1), 6) AS criticality, is_test_flow FROM fl",
    "affected_flows": f"WITH RECURSIVE {G}, {_FLOWS} SELECT flow_id, size FROM fl WHERE flow_id IN (SELECT f FROM mb JOIN n ON n.id = mb.id WHERE r <= 200 AND n.is_test)",
    "tested_by": f"""WITH {G} SELECT DISTINCT d.id AS src, s.id AS dst FROM e JOIN n s ON s.id = src JOIN n d ON d.id = dst WHERE e.kind = 'calls' AND coalesce(s.is_test, false) AND NOT coalesce(d.is_test, false) AND d.qualified_name NOT LIKE 'call::%'
        AND NOT EXISTS (SELECT 1 FROM e t WHERE t.kind = 'tested_by' AND t.src = d.id AND t.dst = s.id)""",
    "test_coverage": f"WITH {G} SELECT qualified_name, id IN (SELECT src FROM e WHERE kind = 'tested_by') AS covered FROM n WHERE kind IN ('function', 'method') AND NOT coalesce(is_test, false)",
    "call_tiers": f"WITH {_GC}, {_CALL_TIERS}",
    "mentions_resolve": f"""WITH {_GP}, p AS (SELECT id, unnest(CAST(json_extract(properties, '$.pending_mentions') AS JSON[])) AS m FROM n WHERE json_valid(properties)),
        q AS (SELECT id AS section_id, m ->> 0 AS token, TRY_CAST(m ->> 1 AS DOUBLE) AS confidence FROM p WHERE m ->> 0 IS NOT NULL),
        ks AS (SELECT id, unnest(['n:' || name, 'n:' || list_extract(string_split(qualified_name, '::'), -1), 's:' || {_snake('name')}]) AS key FROM n WHERE kind IN ({_MENTIONABLE})),
        f AS (SELECT key, min(id) AS node_id FROM ks WHERE key IS NOT NULL GROUP BY 1),
        hit AS (SELECT section_id, token, min(node_id) AS node_id, max(confidence) AS confidence FROM (SELECT *, unnest(['n:' || token, 's:' || {_snake('token')}]) AS key FROM q) JOIN f USING (key) GROUP BY 1, 2)
        SELECT section_id, node_id, round(max(confidence), 6) AS confidence FROM hit WHERE NOT EXISTS (SELECT 1 FROM e WHERE src = section_id AND dst = node_id) GROUP BY 1, 2""",
    "active_at": f"WITH {_GV} SELECT qualified_name, kind FROM {_active('n', 'n.*', HEAD)}",
    "temporal_diff": f"WITH {_GT} {_diff('node', 'n', 'id')} UNION ALL {_diff('edge', 'e', 'edge_id')}",
    "hunk_to_nodes": f"""WITH {G}, h AS (SELECT DISTINCT source_uri AS path, line_start AS s, line_start + 4 AS z FROM n WHERE kind = 'class' AND source_uri IS NOT NULL AND line_start IS NOT NULL),
        j AS (SELECT path, s, n.id, {sql_case('kind', NODE_WEIGHTS, SPECIFICITY, 2)} AS sp FROM h JOIN n ON (source_uri = path OR ends_with(source_uri, path) OR ends_with(path, source_uri)) AND line_start <= z AND greatest(coalesce(line_end, line_start), line_start) >= s),
        b AS (SELECT *, max(sp) OVER (PARTITION BY path, s) AS best FROM j) SELECT path, s AS new_start, id AS node_id, sp::INT AS specificity FROM b WHERE sp > 1 OR best <= 1""",
    "changed_ranges": f"""WITH {G}, h AS (SELECT DISTINCT 'work/' || source_uri AS path, line_start AS s, line_start + 4 AS z FROM n WHERE kind = 'class' AND source_uri IS NOT NULL AND line_start IS NOT NULL),
        j AS (SELECT path, s, n.id, n.qualified_name, greatest(coalesce(line_end, line_start), line_start) - line_start AS w, {sql_case('kind', NODE_WEIGHTS, SPECIFICITY, 2)} AS sp FROM h JOIN n ON (source_uri = path OR ends_with(source_uri, path) OR ends_with(path, source_uri)) AND line_start <= z AND greatest(coalesce(line_end, line_start), line_start) >= s),
        b AS (SELECT *, max(sp) OVER (PARTITION BY path, s) AS best FROM j), r AS (SELECT *, row_number() OVER (PARTITION BY path, s ORDER BY sp DESC, w, id) AS r FROM b WHERE sp > 1 OR best <= 1)
        SELECT path, s AS new_start, string_agg(qualified_name, '|' ORDER BY r) AS symbols FROM r WHERE r <= 20 GROUP BY 1, 2""",
    "risk_score": f"""WITH {G}, {_D}, r AS (SELECT qualified_name, least(100, 0.8 + 1.2 * ind + 0.25 * deg + CASE WHEN id IN (SELECT src FROM e WHERE kind = 'tested_by') THEN 0 ELSE 2.5 END) AS s FROM d WHERE kind IN ('function', 'method') AND NOT coalesce(is_test, false))
        SELECT qualified_name, round(s, 6) AS risk_score, CASE WHEN s >= 35 THEN 'high' WHEN s >= 12 THEN 'medium' ELSE 'low' END AS risk FROM r""",
}
