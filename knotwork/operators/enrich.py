"""Passes that complete an extracted graph: call resolution, mentions, tests, birth commits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotwork.functions.names import path_stem, snake
from knotwork.graph import PLACEHOLDER, PropertyGraph, is_placeholder

CALLABLE = ("function", "method", "class", "type")
MENTIONABLE = ("function", "class", "method", "type", "trait", "impl")
#: What variables of these names usually hold.
NAMED_TYPES = {
    "graph": "Graph", "main_graph": "Graph", "app_graph": "Graph", "g": "Graph", "motif": "MotifBuilder", "mb": "MotifBuilder", "motif_builder": "MotifBuilder",
    "store": "Store", "db": "Store", "database": "Store", "parser": "Parser", "ts_parser": "Parser", "config": "Config", "cfg": "Config",
    "ctx": "Context", "context": "Context", "options": "Options", "opts": "Options",
}


def folder(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def impl_type(qualified_name: Column) -> Column:
    """The segment before a method's name, unless it looks like a path."""
    part = F.try_element_at(F.split(qualified_name, "::"), F.lit(-2))
    return F.when(~part.rlike(r"[/.]"), part)


def let_type(source: Column, variable: Column) -> Column:
    """Type of a variable bound in a source text by annotation, constructor path or literal; upper-case names only."""
    pattern = lambda tail: F.concat(F.lit(r"(?:let|const|var)\s+(?:mut\s+)?"), variable, F.lit(tail))
    found = [F.call_function("regexp_extract", source, pattern(tail), F.lit(1)) for tail in (r"\s*:\s*&?(?:mut\s+)?([A-Z]\w*)", r"\s*=\s*(?:new\s+)?([A-Z]\w*)::", r"\s*=\s*(?:new\s+)?([A-Z]\w*)\s*[({]")]
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in found])


def call_candidates(graph: PropertyGraph) -> DataFrame:
    """Open calls with their candidates: one row per (edge, candidate) of equal name.

    graph.edges needs call_scope and call_receiver, graph.nodes source_text. The caller's text is read for the type
    of the receiver before the candidates come in, so that no text travels with them.
    """
    n = graph.nodes
    open_ = n.where(is_placeholder(F.col("qualified_name"))).select(F.col("id").alias("dst"), F.substr("qualified_name", F.lit(len(PLACEHOLDER) + 1)).alias("callee"))
    caller = n.select(F.col("id").alias("src"), F.col("qualified_name").alias("from_name"), F.col("source_uri").alias("from_file"), F.col("source_text").alias("from_text"))
    to = n.where(F.col("kind").isin(*CALLABLE) & ~is_placeholder(F.col("qualified_name"))).select(F.col("id").alias("candidate"), F.col("name").alias("callee"), F.col("qualified_name").alias("to_name"), F.col("source_uri").alias("to_file"))
    calls = graph.edges.where("kind = 'calls'").select("edge_id", "src", "dst", "call_scope", "call_receiver")
    plain = F.regexp_replace("call_receiver", r"\W", "")
    bound = calls.join(caller, "src").withColumn("bound_type", let_type(F.col("from_text"), plain)).drop("from_text")
    return bound.join(open_, "dst").join(to, "callee")


def resolve_calls(graph: PropertyGraph) -> DataFrame:
    """(edge_id, candidate, resolved_from): the target of each open call that a tier decides.

    The first tier with exactly one candidate wins: unique; same_file; scope (the scope is part of its name) or
    the longest common prefix with the caller among several; receiver (self, a binding in the text, a usual name);
    import (its module is imported by the caller's file); same_dir; frequency (most calls already). Every
    tier is a windowed count over one candidate join.
    """
    c = call_candidates(graph)
    imports = graph.edges.where("kind = 'imports'").join(graph.nodes.select(F.col("id").alias("src"), F.col("source_uri").alias("file")), "src").join(graph.nodes.select(F.col("id").alias("dst"), F.lower("qualified_name").alias("module")), "dst")
    tokens = imports.where("file is not null").select(F.col("file").alias("from_file"), F.explode(F.split("module", r"[^a-z0-9_]+")).alias("stem")).where("stem <> ''").distinct().withColumn("imported", F.lit(True))
    heat = graph.edges.where("kind = 'calls'").groupBy(F.col("dst").alias("candidate")).agg(F.count("*").alias("heat"))
    c = c.withColumn("stem", F.lower(path_stem(F.col("to_file")))).join(tokens, ["from_file", "stem"], "left").join(heat, "candidate", "left")
    named = F.coalesce(F.create_map(*[F.lit(x) for pair in NAMED_TYPES.items() for x in pair])[F.lower("call_receiver")], F.lit(None))
    receiver = F.when(F.col("call_receiver") == "self", impl_type(F.col("from_name"))).otherwise(F.coalesce("bound_type", named))
    common = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.size(F.split("to_name", "::")), F.lit(1))), lambda i: F.slice(F.split("to_name", "::"), 1, i) == F.slice(F.split("from_name", "::"), 1, i)))
    scoped = F.col("call_scope").isNotNull() & F.col("to_name").contains(F.col("call_scope"))
    of_edge = Window.partitionBy("edge_id")
    c = c.withColumn("common", F.when(scoped, common)).withColumn("best_common", F.max("common").over(of_edge)).withColumn("best_heat", F.max("heat").over(of_edge))
    tiers = {
        "unique": F.lit(True),
        "same_file": F.col("from_file") == F.col("to_file"),
        "scope": scoped,
        "scope_prefix": scoped & (F.col("common") == F.col("best_common")) & (F.col("common") > 0),
        "receiver": F.coalesce(impl_type(F.col("to_name")) == receiver, F.lit(False)),
        "import": F.coalesce("imported", F.lit(False)),
        "same_dir": folder(F.col("from_file")) == folder(F.col("to_file")),
        "frequency": F.coalesce((F.col("heat") == F.col("best_heat")) & (F.col("heat") > 0), F.lit(False)),
    }
    pick = None
    for i, (tag, hit) in enumerate(tiers.items()):
        hit = F.coalesce(hit, F.lit(False))
        won = hit & (F.sum(hit.cast("int")).over(of_edge) == 1)
        c = c.withColumn(f"t{i}", F.when(won, F.struct(F.lit(i).alias("tier"), "candidate", F.lit(tag).alias("tag"))))
        pick = F.col(f"t{i}") if pick is None else F.coalesce(pick, F.col(f"t{i}"))
    return c.select("edge_id", pick.alias("p")).where("p is not null").groupBy("edge_id").agg(F.min("p").alias("p")).select("edge_id", "p.candidate", F.col("p.tag").alias("resolved_from"))


def apply_resolution(graph: PropertyGraph) -> PropertyGraph:
    """The graph with open calls pointed at their targets; placeholders left without edges are dropped.

    unique and same_file targets count as extracted, the others as inferred with confidence 0.7.
    """
    r = resolve_calls(graph).withColumnRenamed("resolved_from", "_tag")
    e = graph.edges.join(r, "edge_id", "left")
    sure, hit = F.col("_tag").isin("unique", "same_file"), F.col("_tag").isNotNull()
    e = e.withColumn("dst", F.coalesce("candidate", "dst")).withColumn("conf_class", F.when(hit & sure, "extracted").when(hit, "inferred").otherwise(F.col("conf_class")))
    e = e.withColumn("confidence", F.when(hit & sure, 1.0).when(hit, 0.7).otherwise(F.col("confidence")))
    if "resolved_from" in graph.edges.columns:
        e = e.withColumn("resolved_from", F.coalesce("_tag", "resolved_from"))
    e = e.select(*graph.edges.columns)
    used = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    open_ = is_placeholder(F.col("qualified_name"))
    nodes = graph.nodes.where(~open_).unionByName(graph.nodes.where(open_).join(used, "id", "left_semi").select(*graph.nodes.columns))
    return PropertyGraph(nodes, e)


def tested_by(graph: PropertyGraph) -> DataFrame:
    """Distinct (src, dst) of new tested_by edges: production code called by a test, to that test."""
    side = graph.nodes.select("id", F.coalesce("is_test", F.lit(False)).alias("test"), is_placeholder(F.col("qualified_name")).alias("open"))
    calls = graph.edges.where("kind = 'calls'").select("src", "dst").distinct()
    j = calls.join(side.select(F.col("id").alias("src"), F.col("test").alias("ts")), "src").join(side.select(F.col("id").alias("dst"), F.col("test").alias("td"), "open"), "dst")
    new = j.where("ts and not td and not open").select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct()
    return new.join(graph.edges.where("kind = 'tested_by'").select("src", "dst"), ["src", "dst"], "left_anti")


def resolve_mentions(pending: DataFrame, graph: PropertyGraph) -> DataFrame:
    """(section_id, node_id, confidence) of pending mentions (section_id, token, confidence).

    A token names the first node (by id) of a symbol kind whose name is the token, whose qualified name ends in
    ``::token``, or whose name in snake form is the token's. Pairs that are linked already are left out; of
    several mentions of a pair the surest counts.
    """
    n = graph.nodes.where(F.col("kind").isin(*MENTIONABLE)).select("id", "name", "qualified_name")
    leaf = F.element_at(F.split("qualified_name", "::"), -1)
    keys = n.select("id", F.explode(F.array_distinct(F.array(F.concat(F.lit("n:"), "name"), F.concat(F.lit("n:"), leaf), F.concat(F.lit("s:"), snake(F.col("name")))))).alias("key")).where("key is not null")
    first = keys.groupBy("key").agg(F.min("id").alias("node_id"))
    asked = pending.select("section_id", "token", "confidence", F.explode(F.array(F.concat(F.lit("n:"), "token"), F.concat(F.lit("s:"), snake(F.col("token"))))).alias("key"))
    hit = asked.join(first, "key").groupBy("section_id", "token").agg(F.min("node_id").alias("node_id"), F.max("confidence").alias("confidence"))
    pairs = hit.groupBy("section_id", "node_id").agg(F.max("confidence").alias("confidence"))
    return pairs.join(graph.edges.select(F.col("src").alias("section_id"), F.col("dst").alias("node_id")), ["section_id", "node_id"], "left_anti")


def pending_mentions(nodes: DataFrame) -> DataFrame:
    """(section_id, token, confidence) from the pending_mentions property of sections."""
    pairs = F.try_variant_get(F.try_parse_json("properties"), "$.pending_mentions", "array<array<string>>")
    rows = nodes.select(F.col("id").alias("section_id"), F.explode(pairs).alias("p"))
    return rows.select("section_id", F.try_element_at("p", F.lit(1)).alias("token"), F.try_element_at("p", F.lit(2)).try_cast("double").alias("confidence")).where("token is not null")


def stamp_birth(rows: DataFrame, commit: str, earlier: DataFrame | None = None, key: str = "qualified_name") -> DataFrame:
    """Rows with valid_from filled: the one of the same key in ``earlier`` if it has one, else ``commit``."""
    if earlier is None:
        return rows.withColumn("valid_from", F.coalesce("valid_from", F.lit(commit)))
    old = earlier.where("valid_from is not null").groupBy(key).agg(F.min("valid_from").alias("_old"))
    return rows.join(old, key, "left").withColumn("valid_from", F.coalesce("_old", "valid_from", F.lit(commit))).select(*rows.columns)


def alias_targets(imports: DataFrame, aliases: DataFrame, files: DataFrame) -> DataFrame:
    """(import, path) of module imports by path aliases (config_dir, pattern, target), the file existing.

    imports has (import, importer), files has (path). The nearest configuration above the importer counts; a
    pattern is exact or has one ``*``; endings and index files are probed in order.
    """
    # every folder above the importer, the root included, is a key
    parts = F.split("importer", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    i = imports.select("import", "importer", F.explode(above).alias("_dir")).join(aliases.withColumn("_dir", F.regexp_replace("config_dir", "/+$", "")), "_dir").drop("_dir")
    prefix, suffix = F.split("pattern", r"\*")[0], F.try_element_at(F.split("pattern", r"\*"), F.lit(2))
    exact = F.col("import") == F.col("pattern")
    wild = F.col("pattern").contains("*") & F.col("import").startswith(prefix) & F.col("import").endswith(F.coalesce(suffix, F.lit("")))
    rest = F.expr("substring(import, length(split(pattern, '\\\\*')[0]) + 1, length(import) - length(replace(pattern, '*', '')))")
    i = i.where(exact | wild).withColumn("base", F.when(exact, F.col("target")).otherwise(F.replace("target", F.lit("*"), rest)))
    i = i.withColumn("base", F.when(F.col("config_dir") == "", F.col("base")).otherwise(F.concat_ws("/", F.regexp_replace("config_dir", "/+$", ""), "base")))
    probes = F.array(*[F.struct(F.lit(k).alias("k"), F.concat("base", F.lit(x)).alias("path")) for k, x in enumerate(("", ".ts", ".tsx", ".d.ts", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js"))])
    i = i.select("import", "importer", F.length(F.regexp_replace("config_dir", "/+$", "")).alias("near"), exact.alias("exact"), F.explode(probes).alias("p")).select("import", "importer", "near", "exact", "p.*")
    best = i.join(files, "path").groupBy("import", "importer").agg(F.max(F.struct("near", "exact", (-F.col("k")).alias("k"), "path")).alias("r"))
    return best.select("import", "importer", "r.path")
