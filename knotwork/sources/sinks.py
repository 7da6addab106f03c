"""Writers: GraphML, a Markdown report, JSON pages."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.graph import PropertyGraph
from knotwork.operators import communities, refactor, structure

_HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">'
_NODE_KEYS = ("kind", "name", "qualified_name", "source_uri", "community")
_EDGE_KEYS = ("kind", "confidence")


def xml_escape(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def graphml_lines(graph: PropertyGraph, membership: DataFrame | None = None) -> DataFrame:
    """(part, line): head, one line per node and edge, foot; ``part`` orders them."""
    n = graph.nodes.select("id", *_NODE_KEYS[:4])
    n = n.join(membership.select("id", F.col("community").cast("string").alias("community")), "id", "left") if membership is not None else n.withColumn("community", F.lit(None).cast("string"))
    data = lambda keys, p: [F.coalesce(F.concat(F.lit(f'<data key="{p}{k}">'), xml_escape(F.col(k).cast("string")), F.lit("</data>")), F.lit("")) for k in keys]
    node = F.concat(F.lit('<node id="n'), F.col("id").cast("string"), F.lit('">'), *data(_NODE_KEYS, "n_"), F.lit("</node>"))
    edge = F.concat(F.lit('<edge source="n'), F.col("src").cast("string"), F.lit('" target="n'), F.col("dst").cast("string"), F.lit('">'), *data(_EDGE_KEYS, "e_"), F.lit("</edge>"))
    keys = "".join(f'<key id="{p}{k}" for="{w}" attr.name="{k}" attr.type="string"/>' for p, w, ks in (("n_", "node", _NODE_KEYS), ("e_", "edge", _EDGE_KEYS)) for k in ks)
    spark = graph.nodes.sparkSession
    frame = spark.createDataFrame([(0, _HEAD + keys + '<graph edgedefault="directed">'), (3, "</graph></graphml>")], "part int, line string")
    return frame.unionByName(n.select(F.lit(1).alias("part"), node.alias("line"))).unionByName(graph.edges.select(F.lit(2).alias("part"), edge.alias("line")))


def write_graphml(graph: PropertyGraph, path: str, membership: DataFrame | None = None) -> None:
    """Text files in ``path`` that make one GraphML document when joined in name order."""
    lines = graphml_lines(graph, membership)
    lines.repartitionByRange("part").sortWithinPartitions("part").select("line").write.mode("overwrite").text(path)


def report(graph: PropertyGraph, membership: DataFrame, top: int = 25) -> str:
    """A Markdown report; its tables are cut to ``top`` rows before they come to the driver."""
    out = ["# Graph report", ""]

    def table(title: str, df: DataFrame) -> None:
        rows = df.limit(top).collect()
        out.extend([f"## {title}", ""])
        if rows:
            out.extend(["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)])
            out.extend("| " + " | ".join(str(x) for x in r) + " |" for r in rows)
        else:
            out.append("none")
        out.append("")

    table("Size", graph.counts())
    table("Confidence", refactor.confidence_mix(graph).orderBy("conf_class"))
    table("Calls", structure.call_resolution(graph))
    table("Hubs", structure.hub_nodes(graph, top).drop("id"))
    table("Communities", communities.listing(graph, membership).orderBy(F.desc("size"), "community").select("community", "size"))
    table("Coupling", refactor.coupling(graph, membership).orderBy(F.desc("edges"), "low", "high"))
    table("Gaps", refactor.gaps(graph).orderBy("qualified_name"))
    table("Surprises", refactor.surprises(graph, membership).orderBy(F.desc("score"), "edge_id"))
    out.extend(["## Warnings", "", *(f"- {w}" for w in refactor.diagnostics(graph) or ["none"]), ""])
    return "\n".join(out)


def page(df: DataFrame, order: list, offset: int = 0, limit: int = 50) -> tuple[DataFrame, dict]:
    """(rows, about) of one page in a total order; limits stay within 1 and 500."""
    limit = max(1, min(500, limit))
    total = df.count()
    rows = df.orderBy(*order).offset(offset).limit(limit)
    return rows, {"total": total, "offset": offset, "limit": limit, "next": offset + limit if offset + limit < total else None}


def to_json(rows: DataFrame, about: dict | None = None) -> str:
    """One page as JSON text."""
    return json.dumps({"rows": [json.loads(x) for x in rows.toJSON().collect()], **(about or {})}, ensure_ascii=False, indent=2)


def graph_page(graph: PropertyGraph, membership: DataFrame | None = None, offset: int = 0, limit: int = 1000, edge_offset: int = 0, edge_limit: int | None = None) -> dict[str, DataFrame]:
    """A page of nodes with degree and community, and one of the edges: limits up to 5,000 and 10,000."""
    limit = max(1, min(5000, limit))
    edge_limit = max(1, min(10_000, edge_limit or 2 * limit))
    n = graph.nodes.join(graph.degrees().select("id", "degree"), "id")
    if membership is not None:
        n = n.join(membership.select("id", "community"), "id", "left")
    return {"nodes": n.orderBy("id").offset(offset).limit(limit), "edges": graph.edges.orderBy("edge_id").offset(edge_offset).limit(edge_limit)}
