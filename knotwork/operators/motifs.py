"""Pattern matching: a small graph of nodes and edges, compiled to a chain of joins."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.functions.names import glob_regex
from knotwork.graph import PropertyGraph


@dataclass(frozen=True)
class NodePattern:
    id: int
    kind: str | None = None
    name: str | None = None
    match: str = "exact"  # exact, contains (any case), glob or regex
    min_degree: int = 0

    def condition(self) -> Column:
        c = F.lit(True)
        if self.kind:
            c = c & (F.col("kind") == self.kind)
        if self.name is not None:
            name = F.col("name")
            c = c & {"exact": lambda: name == self.name, "contains": lambda: F.lower(name).contains(self.name.lower()), "glob": lambda: name.rlike(glob_regex(self.name)), "regex": lambda: name.rlike(self.name)}[self.match]()
        return F.coalesce(c & (F.col("degree") >= self.min_degree), F.lit(False)) if self.min_degree else F.coalesce(c, F.lit(False))


@dataclass(frozen=True)
class EdgePattern:
    source: int
    target: int
    kind: str | None = None


@dataclass(frozen=True)
class Motif:
    nodes: tuple[NodePattern, ...] = ()
    edges: tuple[EdgePattern, ...] = field(default=())

    def node(self, id: int, **options) -> Motif:
        return Motif((*self.nodes, NodePattern(id, **options)), self.edges)

    def edge(self, source: int, target: int, kind: str | None = None) -> Motif:
        return Motif(self.nodes, (*self.edges, EdgePattern(source, target, kind)))

    def validate(self) -> None:
        ids = [n.id for n in self.nodes]
        if len(set(ids)) < len(ids):
            raise ValueError("a node id occurs twice")
        for e in self.edges:
            if e.source not in ids or e.target not in ids:
                raise ValueError(f"edge {e.source} -> {e.target} has no such node")

    @staticmethod
    def from_json(text: str) -> Motif:
        d = json.loads(text)
        keys = ("id", "kind", "name", "match", "min_degree")
        return Motif(tuple(NodePattern(**{k: n[k] for k in keys if n.get(k) is not None}) for n in d.get("nodes", [])), tuple(EdgePattern(e["from"], e["to"], e.get("kind")) for e in d.get("edges", [])))


#: Functions whose name contains sql, called by a function.
SECURITY_AUDIT = Motif().node(0, kind="function", name="sql", match="contains").node(1, kind="function").edge(0, 1, "calls")
#: Two classes that share a base and a heir.
DIAMOND = Motif().node(0, kind="class").node(1, kind="class").node(2, kind="class").node(3, kind="class").edge(0, 1, "inherits").edge(0, 2, "inherits").edge(1, 3, "inherits").edge(2, 3, "inherits")
#: A document and a section that describe the same function.
DOC_TRIANGLE = Motif().node(0, kind="document").node(1, kind="section").node(2, kind="function").edge(0, 1, "defines").edge(1, 2, "mentions").edge(0, 2, "describes")
BUILT_IN = {"security_audit": SECURITY_AUDIT, "diamond_inheritance": DIAMOND, "doc_triangle": DOC_TRIANGLE}


def find_motifs(graph: PropertyGraph, motif: Motif) -> DataFrame:
    """(n<id> for each pattern node): every mapping to different nodes with all pattern edges, others allowed.

    Edges are joined so that each one touches what is bound already; conditions on nodes filter the edges
    before the joins, and parallel edges count once. A pattern without nodes matches nothing; pattern nodes
    without edges are refused where there are several, as they would mean a cross join.
    """
    motif.validate()
    if not motif.nodes:
        return graph.nodes.limit(0).select("id")
    n = graph.nodes
    if any(p.min_degree for p in motif.nodes):
        n = n.join(graph.degrees().select("id", "degree"), "id")
    allowed = {p.id: n.where(p.condition()).select(F.col("id").alias(f"n{p.id}")) for p in motif.nodes}
    if not motif.edges:
        if len(motif.nodes) > 1:
            raise ValueError("pattern nodes without edges can't be joined")
        return allowed[motif.nodes[0].id]
    rest, bound, out = list(motif.edges), set(), None
    while rest:
        e = next((x for x in rest if not bound or x.source in bound or x.target in bound), None)
        if e is None:
            raise ValueError("the pattern isn't connected")
        rest.remove(e)
        links = graph.edges if e.kind is None else graph.edges.where(F.col("kind") == e.kind)
        s, t = f"n{e.source}", f"n{e.target}"
        links = links.where("src <> dst").select(F.col("src").alias(s), F.col("dst").alias(t)).distinct()
        for p in (e.source, e.target):
            if p not in bound:
                links = links.join(allowed[p], f"n{p}", "left_semi")
        shared = [f"n{p}" for p in (e.source, e.target) if p in bound]
        out = links if out is None else out.join(links, shared)
        for p in (e.source, e.target):
            if p not in bound:
                for q in bound - {p}:
                    out = out.where(F.col(f"n{p}") != F.col(f"n{q}"))
        bound |= {e.source, e.target}
    if bound != {p.id for p in motif.nodes}:
        raise ValueError("pattern nodes without edges can't be joined")
    return out.select(*[f"n{p.id}" for p in motif.nodes])
