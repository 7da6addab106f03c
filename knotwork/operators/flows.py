"""Execution flows: what an entry point reaches through calls, and how critical that is."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knotwork.graph import PropertyGraph, is_placeholder
from knotwork.session import stage


def entry_points(graph: PropertyGraph) -> DataFrame:
    """(id, name, is_test): functions and methods that are tests, are named main, or that nothing calls."""
    called = graph.edges.where("kind = 'calls'").select(F.col("dst").alias("id"), F.lit(True).alias("called")).distinct()
    n = graph.nodes.where(F.col("kind").isin("function", "method") & ~is_placeholder(F.col("qualified_name"))).join(called, "id", "left")
    test = F.coalesce("is_test", F.lit(False))
    return n.where(test | F.coalesce(F.lower("name").isin("main", "__main__"), F.lit(False)) | F.col("called").isNull()).select("id", "name", test.alias("is_test"))


def call_links(graph: PropertyGraph) -> DataFrame:
    real = graph.nodes.where(~is_placeholder(F.col("qualified_name"))).select(F.col("id").alias("dst"))
    return graph.edges.where("kind = 'calls' and conf_class <> 'ambiguous'").join(real, "dst", "left_semi").select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct()


def fan_in(graph: PropertyGraph) -> DataFrame:
    return graph.edges.where("kind = 'calls'").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("fan_in"))


def trace(graph: PropertyGraph, depth: int = 6, cap: int = 200, entries: DataFrame | None = None) -> DataFrame:
    """(flow_id, node_id, depth): members of each entry's flow, the ``cap`` most relevant ones.

    The search goes level by level, by id within a level, and a flow stops growing at max(10 x cap, 500) members. In
    a flow above the cap relevance is 1/(depth + 1) + min(0.5, calls from members of the flow/10); ties go to the
    smaller depth, then id, so the entry always stays.
    """
    ceiling = max(10 * cap, 500)
    e = entries if entries is not None else entry_points(graph)
    links = stage(call_links(graph), "flow-links")
    levels = [stage(e.select(F.col("id").alias("source"), "id", F.lit(0).alias("depth")).distinct(), "flows")]
    size = levels[0].select("source", F.lit(1).cast("bigint").alias("size"))
    for d in range(1, depth + 1):
        near = levels[-1].join(links, levels[-1]["id"] == links["a"]).select("source", F.col("b").alias("id")).distinct()
        seen = functools.reduce(DataFrame.unionByName, levels)
        fresh = near.join(seen.select("source", "id"), ["source", "id"], "left_anti").join(size, "source")
        ranked = fresh.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy("id")))
        fresh = stage(ranked.where(F.col("size") + F.col("r") <= ceiling).select("source", "id", F.lit(d).alias("depth")), "flows")
        if fresh.isEmpty():
            break
        levels.append(fresh)
        size = seen.unionByName(fresh).groupBy("source").agg(F.count("*").alias("size")).where(F.col("size") < ceiling)
    found = functools.reduce(DataFrame.unionByName, levels)
    large = stage(found.groupBy("source").agg(F.count("*").alias("n")).where(F.col("n") > cap).select("source"), "large-flows")
    if not large.isEmpty():
        crowded = stage(found.join(large, "source", "left_semi"), "crowded-flows")
        calls = graph.edges.where("kind = 'calls'").select("src", F.col("dst").alias("id"))
        inner = crowded.select("source", "id").join(calls, "id").join(crowded.select("source", F.col("id").alias("src")), ["source", "src"])
        inner = inner.groupBy("source", "id").agg(F.count("*").alias("calls"))
        ranked = crowded.join(inner, ["source", "id"], "left").withColumn("relevance", 1.0 / (F.col("depth") + 1) + F.least(F.lit(0.5), F.coalesce("calls", F.lit(0)) / 10))
        order = Window.partitionBy("source").orderBy(F.desc("relevance"), "depth", "id")
        kept = ranked.withColumn("r", F.row_number().over(order)).where(F.col("r") <= cap).select("source", "id", "depth")
        found = found.join(large, "source", "left_anti").unionByName(kept)
    return found.select(F.col("source").alias("flow_id"), F.col("id").alias("node_id"), "depth")


def flows(graph: PropertyGraph, members: DataFrame, least: int = 3) -> DataFrame:
    """(flow_id, entry_name, size, depth, criticality, is_test_flow) of flows with at least ``least`` members.

    min(0.6, ln(size)/6) + min(0.25, mean fan-in/8) + 0.1 for main or 0.05 for handlers - 0.2 for tests, within 0..1.
    """
    m = members.join(fan_in(graph).withColumnRenamed("id", "node_id"), "node_id", "left").groupBy("flow_id").agg(
        F.count("*").alias("size"), F.max("depth").alias("depth"), F.avg(F.coalesce("fan_in", F.lit(0))).alias("reuse")).where(F.col("size") >= least)
    j = m.join(graph.nodes.select(F.col("id").alias("flow_id"), "name", "is_test"), "flow_id")
    name = F.lower("name")
    shape = F.when(name.isin("main", "__main__"), 0.1).when(name.rlike("^(handle|on_|serve)"), 0.05).otherwise(0.0)
    test = F.coalesce("is_test", F.lit(False))
    score = F.least(F.lit(0.6), F.log("size") / 6) + F.least(F.lit(0.25), F.col("reuse") / 8) + shape - F.when(test, 0.2).otherwise(0.0)
    return j.select("flow_id", F.col("name").alias("entry_name"), "size", "depth", F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)).alias("criticality"), test.alias("is_test_flow"))


def affected_flows(members: DataFrame, all_flows: DataFrame, changed: DataFrame) -> DataFrame:
    """Flows with a changed member; changed has id."""
    hit = members.join(changed.select(F.col("id").alias("node_id")), "node_id", "left_semi").select("flow_id").distinct()
    return all_flows.join(hit, "flow_id", "left_semi")


def as_graph(graph: PropertyGraph, all_flows: DataFrame, members: DataFrame) -> PropertyGraph:
    """The graph with a node per flow, an entry_of edge and member_of edges; ids continue after the largest ones."""
    top = graph.nodes.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    top_edge = graph.edges.agg(F.coalesce(F.max("edge_id"), F.lit(0))).scalar()
    named = all_flows.join(graph.nodes.select(F.col("id").alias("flow_id"), F.col("qualified_name").alias("entry")), "flow_id")
    fill = lambda df, columns, known: df.select(*[known.get(c, F.lit(None)).cast(df_type).alias(c) for c, df_type in columns])
    node = fill(named, graph.nodes.dtypes, {"id": F.col("flow_id") + top, "kind": F.lit("flow"), "name": F.col("entry_name"), "qualified_name": F.concat(F.lit("flow::"), F.col("entry")), "is_test": F.col("is_test_flow")})
    ties = stage(members.join(all_flows.select("flow_id"), "flow_id", "left_semi"), "flow-ties")
    # one edge per member, numbered by (flow, node) hash order within the range after the old edges
    edge = fill(ties, graph.edges.dtypes, {
        "edge_id": top_edge + 1 + F.pmod(F.xxhash64("flow_id", "node_id"), F.lit(2**62)), "src": F.col("node_id"), "dst": F.col("flow_id") + top,
        "kind": F.when(F.col("node_id") == F.col("flow_id"), "entry_of").otherwise("member_of"), "confidence": F.lit(1.0), "conf_class": F.lit("extracted")})
    return PropertyGraph(graph.nodes.unionByName(node), graph.edges.unionByName(edge))
