"""Dead code, rename previews, size and gap reports, surprising edges, diagnostics, architecture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotwork.functions.names import DOC_LANGUAGES, language_of
from knotwork.graph import PropertyGraph, is_placeholder
from knotwork.operators import structure

#: Endings of names that count as entry points.
ENTRY_ENDINGS = ("main", "main_", "test_", "Test", "Handle", "handle_", "serve", "run", "start", "entry", "init", "setup", "new", "default")
#: Endings of names that frameworks use by themselves.
FRAMEWORK_ENDINGS = ("Stack", "Construct", "Resource", "Pipeline", "Model", "BaseModel", "BaseSettings", "DeclarativeBase", "TableBase", "App")
#: Paths, in lower case, whose symbols are never dead.
LIVE_PATH = r"__tests__|\.spec\.|\.test\.|/test_|/e2e_test|(^|/)tests?/"
LIVE_NAME = "(" + "|".join((*ENTRY_ENDINGS, *FRAMEWORK_ENDINGS)) + ")$"


def dead_code(graph: PropertyGraph) -> DataFrame:
    """Functions, methods and classes that nothing calls, imports, tests or inherits.

    Either end of a call or a test counts as alive; names ending like an entry point (so ``renew`` too, by
    ``new``) or a framework class, and symbols in test paths, are left out. One pass over the edges marks
    the living, one anti join drops them.
    """
    e = graph.edges
    ends = F.when(F.col("kind").isin("calls", "tested_by"), F.array("src", "dst")).when(F.col("kind").isin("imports", "inherits", "implements"), F.array("dst"))
    alive = e.where(F.col("kind").isin("calls", "tested_by", "imports", "inherits", "implements")).select(F.explode(ends).alias("id")).distinct()
    n = graph.nodes.where(F.col("kind").isin("function", "method", "class") & ~is_placeholder(F.col("qualified_name")))
    n = n.where(~F.coalesce(F.col("name").rlike(LIVE_NAME), F.lit(False)) & ~F.coalesce(F.lower("source_uri").rlike(LIVE_PATH), F.lit(False)))
    return n.join(alive, "id", "left_anti").select("id", "qualified_name", "name", "kind", "source_uri", "line_start", "line_end")


def rename_preview(graph: PropertyGraph, qualified_name: str, new_name: str) -> DataFrame:
    """(file, line, old, new, confidence) of the places a rename touches, one per file and line.

    The definition, callers and importers are high; out-neighbours whose name contains the old one, and
    whose qualified name lacks the new one, are medium. The first reason in this order wins a line.
    """
    site = ["source_uri", "line_start"]
    target = graph.find(qualified_name).select("id", "name", *site)
    old = target.select(F.col("id").alias("t"), F.col("name").alias("old"))
    e = graph.edges
    near = graph.nodes.select("id", F.col("name").alias("near"), "qualified_name", *site)
    back = e.where(F.col("kind").isin("calls", "imports")).join(old, F.col("dst") == F.col("t")).select(F.col("src").alias("id"), "old", F.when(F.col("kind") == "calls", 1).otherwise(2).alias("order"))
    back = back.join(near, "id").select("old", *site, "order", F.lit("high").alias("confidence"))
    out = e.join(old, F.col("src") == F.col("t")).select(F.col("dst").alias("id"), "old").join(near, "id").where(F.col("near").contains(F.col("old")) & ~F.col("qualified_name").contains(new_name))
    out = out.select("old", *site, F.lit(3).alias("order"), F.lit("medium").alias("confidence"))
    own = target.select(F.col("name").alias("old"), *site, F.lit(0).alias("order"), F.lit("high").alias("confidence"))
    first = Window.partitionBy(*site).orderBy("order")
    edits = own.unionByName(back).unionByName(out).withColumn("r", F.row_number().over(first)).where("r = 1 and source_uri is not null")
    return edits.select(F.col("source_uri").alias("file"), F.col("line_start").alias("line"), "old", F.lit(new_name).alias("new"), "confidence")


def line_span() -> Column:
    return F.col("line_end") - F.col("line_start") + 1


def large_functions(graph: PropertyGraph, min_lines: int = 80) -> DataFrame:
    n = graph.nodes.where(F.col("kind").isin("function", "method", "class", "trait"))
    return n.withColumn("lines", line_span()).where(F.col("lines") >= min_lines).select("qualified_name", "kind", "source_uri", "lines")


def gaps(graph: PropertyGraph) -> DataFrame:
    """(qualified_name, gap): orphan symbols, large leaves and unresolved calls.

    An orphan has no edge at all; a large leaf has more than 40 lines and no outgoing edge; a placeholder
    with callers is an unresolved call.
    """
    j = graph.nodes.join(graph.degrees(), "id")
    symbol = F.col("kind").isin("function", "method", "class", "type", "trait")
    open_ = is_placeholder(F.col("qualified_name"))
    gap = (
        F.when(open_ & (F.col("in_degree") > 0), "unresolved_call")
        .when(~open_ & symbol & (F.col("degree") == 0), "orphan_symbol")
        .when(~open_ & symbol & (F.col("out_degree") == 0) & (line_span() > 40), "large_leaf")
    )
    return j.withColumn("gap", gap).where("gap is not null").select("qualified_name", "gap")


def hub_threshold(graph: PropertyGraph) -> DataFrame:
    """(threshold): the degree at index floor(0.9 n) of the sorted degrees, 4 at least."""
    d = graph.degrees()
    # counts per degree give the index without sorting all nodes in one task
    tally = d.groupBy("degree").agg(F.count("*").alias("k"))
    upto = tally.withColumn("cum", F.sum("k").over(Window.orderBy("degree")))  # rows: distinct degrees
    n = d.agg(F.floor(F.count("*") * F.lit(0.9)).alias("i"))
    return upto.join(F.broadcast(n), F.col("cum") > F.col("i")).agg(F.greatest(F.coalesce(F.min("degree"), F.lit(4)), F.lit(4)).alias("threshold"))


def surprises(graph: PropertyGraph, communities: DataFrame) -> DataFrame:
    """(edge_id, score, cross_community, cross_language): edges that join what is usually apart.

    +1 for crossing communities (id, community), +1.5 for crossing languages, and where both ends are hubs
    1 + min(3, sum of degrees / 2T). Placeholders, inferred calls across languages and calls from code to
    documents are left out.
    """
    t = hub_threshold(graph)
    side = graph.nodes.select("id", "qualified_name", language_of(F.col("source_uri")).alias("lang")).join(graph.degrees().select("id", "degree"), "id").join(communities.select("id", "community"), "id", "left")
    s = side.select(*[F.col(c).alias("s_" + c) for c in side.columns])
    d = side.select(*[F.col(c).alias("d_" + c) for c in side.columns])
    j = graph.edges.join(s, F.col("src") == F.col("s_id")).join(d, F.col("dst") == F.col("d_id")).join(F.broadcast(t))  # t is one row
    j = j.where(~is_placeholder(F.col("s_qualified_name")) & ~is_placeholder(F.col("d_qualified_name")))
    cross = F.coalesce(F.col("s_lang") != F.col("d_lang"), F.lit(False))
    j = j.where(~(cross & (F.col("kind") == "calls") & (F.col("conf_class") == "inferred")))
    j = j.where(~(cross & (F.col("kind") == "calls") & F.col("d_lang").isin(*DOC_LANGUAGES) & ~F.col("s_lang").isin(*DOC_LANGUAGES)))
    far = F.coalesce(F.col("s_community") != F.col("d_community"), F.lit(False))
    hubs = (F.col("s_degree") >= F.col("threshold")) & (F.col("d_degree") >= F.col("threshold"))
    score = F.when(far, 1.0).otherwise(0.0) + F.when(cross, 1.5).otherwise(0.0) + F.when(hubs, 1 + F.least(F.lit(3.0), (F.col("s_degree") + F.col("d_degree")) / (2 * F.col("threshold")))).otherwise(0.0)
    return j.withColumn("score", score).where("score > 0").select("edge_id", "score", far.alias("cross_community"), cross.alias("cross_language"))


def confidence_mix(graph: PropertyGraph) -> DataFrame:
    return graph.edges.groupBy("conf_class").agg(F.count("*").alias("edges"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


def graph_summary(graph: PropertyGraph) -> DataFrame:
    """(what, key, n): nodes by kind, edges by kind, nodes by source."""
    part = lambda df, what, key: df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "key", "n")
    return part(graph.nodes, "node_kind", "kind").unionByName(part(graph.edges, "edge_kind", "kind")).unionByName(part(graph.nodes, "source", "source_uri"))


def diagnostics(graph: PropertyGraph, indexed: int | None = None, embedded: int | None = None) -> list[str]:
    """Warnings about a graph: index empty or stale (below 0.9 of the nodes), no embeddings, resolution below 0.5."""
    r = structure.call_resolution(graph).first()
    n = graph.nodes.count()
    out = []
    if indexed is not None and n and not indexed:
        out.append("text index is empty")
    elif indexed is not None and indexed < 0.9 * n:
        out.append("text index is stale")
    if embedded == 0:
        out.append("no embeddings")
    if r.rate < 0.5:
        out.append("most calls are unresolved")
    return out


def coupling(graph: PropertyGraph, communities: DataFrame) -> DataFrame:
    """(low, high, edges): edges between each unordered pair of communities."""
    c = communities.select("id", "community")
    j = graph.edges.join(c.select(F.col("id").alias("src"), F.col("community").alias("a")), "src").join(c.select(F.col("id").alias("dst"), F.col("community").alias("b")), "dst")
    return j.where("a <> b").groupBy(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).agg(F.count("*").alias("edges"))


def architecture(graph: PropertyGraph, communities: DataFrame, top_files: int = 5) -> DataFrame:
    """(community, size, kinds, files): kind counts and the files with most members of each community."""
    j = graph.nodes.join(communities.select("id", "community"), "id")
    kinds = j.groupBy("community", "kind").agg(F.count("*").alias("n")).groupBy("community").agg(F.sum("n").alias("size"), F.sort_array(F.collect_list(F.struct(F.col("kind"), F.col("n")))).alias("kinds"))
    per_file = j.where("source_uri is not null").groupBy("community", "source_uri").agg(F.count("*").alias("n"))
    ranked = per_file.withColumn("r", F.row_number().over(Window.partitionBy("community").orderBy(F.desc("n"), "source_uri"))).where(F.col("r") <= top_files)
    files = ranked.groupBy("community").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "source_uri"))), lambda x: x["source_uri"]).alias("files"))
    return kinds.join(files, "community", "left")


def coupling_warnings(pairs: DataFrame) -> DataFrame:
    """Pairs of communities with at least 5 edges (medium) or 20 (high)."""
    return pairs.where("edges >= 5").withColumn("severity", F.when(F.col("edges") >= 20, "high").otherwise("medium"))
