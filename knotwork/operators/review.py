"""Change review: which symbols a diff touches, what they reach, and how risky that is."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotwork.functions.names import same_source
from knotwork.graph import PropertyGraph
from knotwork.operators import flows as flow_ops
from knotwork.operators.traverse import impact
from knotwork.weights import SPECIFICITY, node_weight


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def nodes_of_hunks(nodes: DataFrame, hunks: DataFrame) -> DataFrame:
    """(path, new_start, id, specificity): nodes whose lines meet a hunk (path, new_start, new_count).

    Paths match if equal or one ends with the other, so both share the base name, which is the join's key;
    lines meet if [new_start, new_start + max(count, 1) - 1] overlaps [line_start, line_end]. Files and
    documents count only where a hunk meets nothing more specific.
    """
    h = hunks.select("path", "new_start", (F.col("new_start") + F.greatest("new_count", F.lit(1)) - 1).alias("new_end"), base_name(F.col("path")).alias("_base"))
    n = nodes.where("source_uri is not null and line_start is not null").select("id", "kind", "source_uri", "line_start", F.greatest(F.coalesce("line_end", "line_start"), "line_start").alias("line_end"), base_name(F.col("source_uri")).alias("_base"))
    j = h.join(n, (h["_base"] == n["_base"]) & same_source(F.col("path"), F.col("source_uri")) & (F.col("line_start") <= F.col("new_end")) & (F.col("line_end") >= F.col("new_start")))
    s = node_weight(F.col("kind"), SPECIFICITY)
    best = F.max("specificity").over(Window.partitionBy("path", "new_start"))
    j = j.withColumn("specificity", s).withColumn("best", best).where("specificity > 1 or best <= 1")
    return j.select("path", "new_start", "id", F.col("specificity").cast("int").alias("specificity"), (F.col("line_end") - F.col("line_start")).alias("span"))


def nodes_of_files(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """(id) of nodes in files (path), by equal or ending paths."""
    p = paths.select("path", base_name(F.col("path")).alias("_base")).distinct()
    n = nodes.where("source_uri is not null").select("id", "source_uri", base_name(F.col("source_uri")).alias("_base"))
    return n.join(p, (n["_base"] == p["_base"]) & same_source(F.col("path"), F.col("source_uri")), "left_semi").select("id")


def changed_ranges(nodes: DataFrame, hunks: DataFrame, most: int = 20) -> DataFrame:
    """(path, new_start, symbols): the first ``most`` names of each hunk, the most specific and shortest first."""
    j = nodes_of_hunks(nodes, hunks).join(nodes.select("id", "qualified_name"), "id")
    order = Window.partitionBy("path", "new_start").orderBy(F.desc("specificity"), "span", "id")
    ranked = j.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most)
    return ranked.groupBy("path", "new_start").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "qualified_name"))), lambda x: x["qualified_name"]).alias("symbols"))


def test_coverage(graph: PropertyGraph, changed: DataFrame) -> DataFrame:
    """(id, qualified_name, covered) of changed functions and methods that aren't tests."""
    t = graph.edges.where("kind = 'tested_by'").select(F.col("src").alias("id"), F.lit(True).alias("covered")).distinct()
    n = graph.nodes.where(F.col("kind").isin("function", "method") & ~F.coalesce("is_test", F.lit(False))).join(changed.select("id"), "id", "left_semi")
    return n.join(t, "id", "left").select("id", "qualified_name", F.coalesce("covered", F.lit(False)).alias("covered"))


def risk(changed: Column, impacted: Column, degrees: Column, missing: Column, criticality: Column) -> Column:
    """Score of 0 to 100 from counts, the changed nodes' degrees, missing tests and the worst flow touched."""
    worst = F.least(F.greatest(criticality, F.lit(0.0)), F.lit(1.0))
    return F.least(F.lit(100.0), changed * 0.8 + impacted * 1.2 + degrees * 0.25 + missing * 2.5 + worst * 15.0)


def risk_level(score: Column) -> Column:
    return F.when(score >= 35, "high").when(score >= 12, "medium").otherwise("low")


def review(graph: PropertyGraph, changed: DataFrame, max_hops: int = 2, members: DataFrame | None = None, all_flows: DataFrame | None = None, limit: int = 25) -> dict[str, DataFrame]:
    """changed, impacted, coverage, flows and a one-row risk of a set of changed nodes (id)."""
    ids = changed.select("id").distinct()
    # what is impacted by any seed: of several seeds the best score counts
    hits = impact(graph, ids, max_hops).join(ids, "id", "left_anti").groupBy("id").agg(F.max("score").alias("score"), F.min("distance").alias("distance"))
    impacted = hits.join(graph.nodes.select("id", "qualified_name"), "id").orderBy(F.desc("score"), "qualified_name").limit(limit)
    if members is None:
        members = flow_ops.trace(graph)
    if all_flows is None:
        all_flows = flow_ops.flows(graph, members)
    touched = flow_ops.affected_flows(members, all_flows, ids)
    coverage = test_coverage(graph, ids)
    one = ids.agg(F.count("*").alias("changed")).select(
        "changed", impacted.agg(F.count("*")).scalar().alias("impacted"),
        graph.degrees().join(ids, "id", "left_semi").agg(F.coalesce(F.sum("degree"), F.lit(0))).scalar().alias("degrees"),
        coverage.where("not covered").agg(F.count("*")).scalar().alias("missing"),
        touched.agg(F.coalesce(F.max("criticality"), F.lit(0.0))).scalar().alias("criticality"))
    score = risk(*[F.col(c) for c in ("changed", "impacted", "degrees", "missing", "criticality")])
    named = graph.nodes.join(ids, "id", "left_semi")
    return {"changed": named, "impacted": impacted, "coverage": coverage, "flows": touched, "risk": one.withColumn("risk_score", score).withColumn("risk", risk_level(F.col("risk_score")))}


def snippets(files: DataFrame, ranges: DataFrame, context: int = 4, max_lines: int = 200) -> DataFrame:
    """(path, line_no, text): numbered lines of files (path, text) around ranges (path, line_start, line_end).

    Windows of ``context`` lines that overlap show a line once; ``max_lines`` a file. A gap in line_no is a cut.
    """
    lines = files.select("path", F.posexplode(F.split("text", r"\r?\n")).alias("i", "text")).select("path", (F.col("i") + 1).alias("line_no"), "text")
    r = ranges.select("path", (F.col("line_start") - context).alias("low"), (F.col("line_end") + context).alias("high"))
    near = lines.join(r, (lines["path"] == r["path"]) & (F.col("line_no") >= F.col("low")) & (F.col("line_no") <= F.col("high")), "left_semi")
    return near.withColumn("r", F.row_number().over(Window.partitionBy("path").orderBy("line_no"))).where(F.col("r") <= max_lines).drop("r")


def within_budget(costs: Iterable[tuple[str, int]], token_budget: int = 1600) -> tuple[int, list[str]]:
    """(tokens used, paths) by a greedy fold of (path, tokens): the first always enters, later ones only if they fit."""
    used, out = 0, []
    for path, cost in costs:
        if not out or used + cost <= token_budget:
            out.append(path)
            used += cost
    return used, out


def suggested_questions(changed_files: DataFrame, impacted: DataFrame, limit: int = 10) -> DataFrame:
    """(question): one per changed file (path) and impacted node (qualified_name), and a general one."""
    a = changed_files.select(F.lit(0).alias("o"), F.format_string("What changed in %s, and does a test cover it?", F.col("path")).alias("question"))
    b = impacted.select(F.lit(1).alias("o"), F.format_string("Could the change break %s?", F.col("qualified_name")).alias("question"))
    c = impacted.sparkSession.range(1).select(F.lit(2).alias("o"), F.lit("Which flows should be tested again before merging?").alias("question"))
    return a.unionByName(b).unionByName(c).orderBy("o", "question").limit(limit).select("question")
