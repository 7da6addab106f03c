"""Named operations over a graph, with paging, detail levels and hints: one entry point for tools."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.graph import PropertyGraph
from knotwork.operators import centrality, communities, flows, motifs, refactor, review, search, structure, temporal, traverse
from knotwork.session import stage
from knotwork.sources import sinks
from knotwork.weights import STRUCTURAL

ALIASES = {
    "context": "minimal_context", "k_core": "core", "articulation_points": "articulation", "surprise_scoring": "surprises", "health": "diagnostics",
    "architecture": "architecture_overview", "impact_radius": "blast_radius",
}
#: What is worth asking after each operation.
NEXT = {
    "minimal_context": ("search", "impact", "detect_changes"), "search": ("impact", "traverse", "find_related"), "impact": ("test_coverage", "affected_flows", "review_context"),
    "detect_changes": ("review_context", "affected_flows", "test_coverage"), "review_context": ("suggested_questions", "test_coverage"), "status": ("diagnostics", "architecture_overview"),
    "cycles": ("core", "articulation"), "bridge_nodes": ("articulation", "community_split"), "dead_code": ("rename_preview", "test_coverage"), "architecture_overview": ("bridge_nodes", "knowledge_gaps"),
}


@dataclass
class Session:
    """What a user did lately; bounded."""

    tools: deque = field(default_factory=lambda: deque(maxlen=100))
    nodes: deque = field(default_factory=lambda: deque(maxlen=1000))
    files: deque = field(default_factory=lambda: deque(maxlen=500))

    def hints(self, operation: str, risk_score: float | None = None) -> dict:
        """Up to three operations that follow this one and weren't used yet, and warnings."""
        self.tools.append(operation)
        warn = ["high risk: review the affected flows"] if risk_score is not None and risk_score >= 35 else []
        return {"next": [x for x in NEXT.get(operation, ("search", "status")) if x not in self.tools][:3], "warnings": warn}


@dataclass
class Context:
    """A graph with its side tables; derived frames are made and stored once, when asked for."""

    graph: PropertyGraph
    commits: DataFrame | None = None
    hunks: DataFrame | None = None
    vectors: DataFrame | None = None
    files: DataFrame | None = None
    algorithm: str = "leiden"
    session: Session = field(default_factory=Session)
    _made: dict = field(default_factory=dict)

    def once(self, name: str, make: Callable):
        if name not in self._made:
            self._made[name] = make()
        return self._made[name]

    @property
    def communities(self) -> DataFrame:
        return self.once("communities", lambda: stage(communities.detect(self.graph, self.algorithm), "communities"))

    @property
    def members(self) -> DataFrame:
        return self.once("members", lambda: stage(flows.trace(self.graph), "members"))

    @property
    def flows(self) -> DataFrame:
        return self.once("flows", lambda: stage(flows.flows(self.graph, self.members), "flows"))

    def seed(self, target: str) -> DataFrame:
        return self.graph.nodes.where(F.col("id") == search.resolve_symbol(self.graph, target)).select("id")

    def named(self, df: DataFrame) -> DataFrame:
        return df.join(self.graph.nodes.select("id", "qualified_name", F.col("kind"), "source_uri"), "id")

    def changed(self) -> DataFrame:
        if self.hunks is None:
            raise ValueError("the context has no hunks")
        by_line = review.nodes_of_hunks(self.graph.nodes, self.hunks).select("id").distinct()
        return by_line if not by_line.isEmpty() else review.nodes_of_files(self.graph.nodes, self.hunks).distinct()

    def reviewed(self, max_depth: int = 2, limit: int = 25) -> dict[str, DataFrame]:
        return review.review(self.graph, self.changed(), max_depth, self.members, self.flows, limit)


def _bridges(c: Context, **_):
    return c.named(structure.bridge_scores(c.graph, c.communities)).orderBy(F.desc("score"), "qualified_name")


def _diff(c: Context, base: str, head: str, **_):
    n = temporal.temporal_diff(c.graph.nodes, c.commits, base, head, "id").select(F.lit("node").alias("what"), F.col("id").alias("key"), "change")
    return n.unionByName(temporal.temporal_diff(c.graph.edges, c.commits, base, head, "edge_id").select(F.lit("edge").alias("what"), F.col("edge_id").alias("key"), "change")).orderBy("what", "key")


def _coverage(c: Context, target: str | None = None, **_):
    return review.test_coverage(c.graph, c.seed(target) if target else c.changed()).orderBy("qualified_name")


def _context_snippets(c: Context, max_lines_per_file: int = 200, token_budget: int = 1600, **_):
    lines = review.snippets(c.files, c.hunks.select("path", F.col("new_start").alias("line_start"), (F.col("new_start") + F.col("new_count")).alias("line_end")), max_lines=max_lines_per_file)
    per = lines.groupBy("path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "text"))), lambda x: F.format_string("%d: %s", x["line_no"], x["text"])), "\n").alias("text"))
    per = stage(per, "snippets")
    # of every file only its size comes here; texts only of those within the budget
    sizes = per.select("path", F.ceil(F.length("text") / 4).alias("cost")).orderBy("path").toLocalIterator()
    used, chosen = review.within_budget(((r.path, r.cost) for r in sizes), token_budget)
    return per.where(F.col("path").isin(chosen)).select("path", "text", F.lit(used).alias("used_tokens"))


def _paths(c: Context, source: str, target: str, max_hops: int = 5, limit: int = 10, structural_only: bool = False, **_):
    best = traverse.top_paths(c.graph, c.seed(source), c.seed(target), max_hops, limit, kinds=list(STRUCTURAL) if structural_only else None).collect()  # at most ``limit``
    rows = [(i, path, float(cost), len(path) - 1) for i, (path, cost) in enumerate(traverse.diversify([(r.path, r.cost) for r in best]), 1)]
    return c.graph.nodes.sparkSession.createDataFrame(rows, "rank int, path array<bigint>, cost double, hops int")


def _split(c: Context, threshold: float = 0.25, min_size: int = 10, **_):
    return communities.listing(c.graph, communities.split_oversized(c.graph, threshold, min_size)).orderBy(F.desc("size"), "community")


def _status(c: Context, **_):
    r = structure.call_resolution(c.graph)
    return c.graph.counts().select("nodes", "edges", *[r.select(x).scalar().alias(x) for x in ("resolved", "unresolved", "rate")])


def _god(c: Context, limit: int = 10, seed: str | None = None, **_):
    seeds = c.seed(seed).withColumn("weight", F.lit(1.0)) if seed else None
    rank = centrality.pagerank(c.graph, seeds=seeds)
    return rank.join(centrality.without_rank_noise(c.graph.nodes), "id").select("qualified_name", "kind", F.col("rank").alias("score")).orderBy(F.desc("score"), "qualified_name").limit(limit)


def _related(c: Context, target: str, limit: int = 25, **_):
    node = search.resolve_symbol(c.graph, target)
    hits = search.related(c.vectors.withColumnRenamed("node_id", "id"), "id", "vector", node)
    return c.named(hits).where("kind <> 'file'").orderBy(F.desc("score"), "id").limit(limit)


def _motifs(c: Context, built_in: str = "security_audit", pattern: str | None = None, **_):
    return motifs.find_motifs(c.graph, motifs.Motif.from_json(pattern) if pattern else motifs.BUILT_IN[built_in])


def _minimal(c: Context, target: str = "", **_):
    top, risk = search.minimal_context(c.graph, target)
    return c.graph.nodes.sparkSession.createDataFrame([(r.qualified_name, r.kind, float(r.score), risk) for r in top], "qualified_name string, kind string, score double, risk string")


def _report(c: Context, top: int = 25, **_):
    return c.graph.nodes.sparkSession.createDataFrame([(sinks.report(c.graph, c.communities, top),)], "report string")


def _diagnostics(c: Context, **_):
    return c.graph.nodes.sparkSession.createDataFrame([(w,) for w in refactor.diagnostics(c.graph, embedded=c.vectors.count() if c.vectors is not None else 0)], "warning string")


OPERATIONS: dict[str, Callable[..., DataFrame]] = {
    "minimal_context": _minimal,
    "status": _status,
    "search": lambda c, query="", limit=20, **_: search.ranked_search(c.graph, query, limit),
    "paths": lambda c, **p: _paths(c, **{{"from": "source", "to": "target"}.get(k, k): v for k, v in p.items()}),
    "impact": lambda c, target, max_hops=4, limit=25, **_: c.named(traverse.impact(c.graph, c.seed(target), max_hops).drop("source")).orderBy(F.desc("score"), "distance", "qualified_name").limit(limit),
    "callers": lambda c, target, **_: c.named(traverse.callers_of(c.graph, c.seed(target)).select(F.col("caller").alias("id"))).orderBy("qualified_name"),
    "callees": lambda c, target, **_: c.named(traverse.callees_of(c.graph, c.seed(target)).select(F.col("callee").alias("id"))).orderBy("qualified_name"),
    "detect_changes": lambda c, max_depth=2, **_: c.reviewed(max_depth)["changed"].orderBy("qualified_name"),
    "review_context": _context_snippets,
    "traverse": lambda c, target, direction="both", max_depth=3, token_budget=1200, **_: traverse.traverse(c.graph, c.seed(target), direction, max_depth, token_budget).orderBy("depth", "qualified_name"),
    "large_functions": lambda c, min_lines=80, **_: refactor.large_functions(c.graph, min_lines).orderBy(F.desc("lines"), "qualified_name"),
    "bridge_nodes": _bridges,
    "cycles": lambda c, **_: structure.cycles(c.graph).orderBy(F.desc("size"), "component"),
    "core": lambda c, **_: c.named(structure.core_numbers(c.graph)).orderBy(F.desc("core"), "qualified_name"),
    "articulation": lambda c, **_: c.named(structure.articulation_points(c.graph)).orderBy("qualified_name"),
    "gaps": lambda c, **_: refactor.gaps(c.graph).orderBy("qualified_name"),
    "surprises": lambda c, **_: refactor.surprises(c.graph, c.communities).orderBy(F.desc("score"), "edge_id"),
    "diagnostics": _diagnostics,
    "graph_diff": _diff,
    "counterfactual": lambda c, target, direction="out", max_depth=5, **_: c.named(traverse.counterfactual(c.graph, c.seed(target), direction, max_depth)).orderBy("id"),
    "motifs": _motifs,
    "suggested_questions": lambda c, limit=10, **_: review.suggested_questions(c.hunks.select("path").distinct(), c.reviewed()["impacted"], limit),
    "architecture_overview": lambda c, **_: refactor.architecture(c.graph, c.communities).orderBy(F.desc("size"), "community"),
    "god_nodes": _god,
    "flows": lambda c, **_: c.flows.orderBy(F.desc("criticality"), "flow_id"),
    "affected_flows": lambda c, **_: c.reviewed()["flows"].orderBy(F.desc("criticality"), "flow_id"),
    "blast_radius": lambda c, max_depth=2, limit=25, **_: c.reviewed(max_depth, limit)["impacted"].orderBy(F.desc("score"), "qualified_name"),
    "risk": lambda c, **_: c.reviewed()["risk"],
    "test_coverage": _coverage,
    "report": _report,
    "hub_nodes": lambda c, limit=25, **_: structure.hub_nodes(c.graph, limit),
    "knowledge_gaps": lambda c, **_: communities.knowledge_gaps(c.graph, c.communities).orderBy("gap", "key"),
    "export_graphml": lambda c, **_: sinks.graphml_lines(c.graph, c.communities).orderBy("part"),
    "find_related": _related,
    "rename_preview": lambda c, target, new_name, **_: refactor.rename_preview(c.graph, target, new_name).orderBy("file", "line"),
    "dead_code": lambda c, **_: refactor.dead_code(c.graph).orderBy("qualified_name"),
    "community_split": _split,
    "communities": lambda c, **_: communities.listing(c.graph, c.communities).orderBy(F.desc("size"), "community"),
    "node_card": lambda c, target, **_: node_card(c, target),
}
DETAIL = {"minimal": 5, "standard": 50, "full": 200}


def node_card(c: Context, target: str) -> DataFrame:
    """(what, qualified_name) of a node: up to ten tests, twenty callers and callees, eight flows."""
    t = c.seed(target)
    name = lambda df, what, n: c.named(df).select(F.lit(what).alias("what"), "qualified_name").distinct().orderBy("qualified_name").limit(n)
    tests = c.graph.edges.where("kind = 'tested_by'").join(t.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id"))
    own = c.members.join(t.withColumnRenamed("id", "node_id"), "node_id", "left_semi").select(F.col("flow_id").alias("id"))
    callers, callees = traverse.callers_of(c.graph, t).select(F.col("caller").alias("id")), traverse.callees_of(c.graph, t).select(F.col("callee").alias("id"))
    return name(tests, "test", 10).unionByName(name(callers, "caller", 20)).unionByName(name(callees, "callee", 20)).unionByName(name(own, "flow", 8))


def run(context: Context, operation: str, **params) -> DataFrame:
    """The full, lazy result of an operation; aliases count."""
    operation = ALIASES.get(operation, operation)
    if operation not in OPERATIONS:
        raise ValueError(f"no operation {operation!r}")
    return OPERATIONS[operation](context, **params)


def respond(context: Context, operation: str, detail_level: str = "standard", response_limit: int | None = None, offset: int = 0, no_hints: bool = False, **params) -> dict:
    """One page of an operation as plain data, with paging and hints."""
    name = ALIASES.get(operation, operation)
    df = run(context, name, **params)
    limit = max(1, min(500, response_limit or DETAIL.get(detail_level, 50)))
    total = df.count()
    rows = [r.asDict(recursive=True) for r in df.offset(offset).limit(limit).collect()]
    out = {"operation": name, "rows": rows, "pagination": {"total": total, "offset": offset, "limit": limit, "next": offset + limit if offset + limit < total else None}}
    if not no_hints:
        score = rows[0].get("risk_score") if rows else None
        out["hints"] = context.session.hints(name, score)
        context.session.nodes.extend(r["qualified_name"] for r in rows if "qualified_name" in r)
        context.session.files.extend(r["source_uri"] for r in rows if r.get("source_uri"))
    return out
