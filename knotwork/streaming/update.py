"""Incremental maintenance of a stored graph when files change."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.graph import PropertyGraph
from knotwork.operators import enrich
from knotwork.session import stage
from knotwork.sources.extract import assemble, build, extract_rows
from knotwork.sources.store import Store


def full_build(store: Store, files: DataFrame, commit: str, now: int | None = None, overlay: str | None = None) -> PropertyGraph:
    """Build from all files (path, content, hash) and store the graph and the hashes."""
    files = stage(files, "files")
    store.save(build(files, commit, overlay=overlay))
    store.set_hashes(files, now if now is not None else int(time.time()))
    return store.load()


def incremental_update(store: Store, files: DataFrame, commit: str, now: int | None = None, overlay: str | None = None) -> DataFrame:
    """(path, change) after bringing the stored graph to the state of all current files (path, content, hash).

    Rows of changed and deleted files are archived as closed at the commit; the changed and new files are
    extracted and put in their place, under the birth commits their names had. Edges from unchanged files into
    changed ones are kept where the name lives on, and otherwise point at a placeholder again. Calls,
    mentions and tests are resolved anew. Nothing is written if no hash differs.
    """
    files = stage(files, "files")
    changes = stage(store.changed_files(files), "changes")
    if changes.isEmpty():
        return changes
    old = store.load()
    touched = changes.where("change <> 'added'").select(F.col("path").alias("source_uri"))
    store.archive(store.of_sources(touched), commit)
    gone = stage(old.nodes.join(touched, "source_uri", "left_semi").select("id", "name", "qualified_name", "valid_from"), "gone")
    nodes = old.nodes.join(gone.select("id"), "id", "left_anti").select(*old.nodes.columns)
    # edges out of the touched files go; edges into them wait for the new rows
    edges = old.edges.join(gone.select(F.col("id").alias("src")), "src", "left_anti").select(*old.edges.columns)
    fresh = assemble(extract_rows(files.join(changes.where("change <> 'deleted'").select("path"), "path", "left_semi"), overlay))
    known = nodes.select("qualified_name")
    new_nodes = fresh.nodes.join(known, "qualified_name", "left_anti")
    new_nodes = enrich.stamp_birth(new_nodes.select(*old.nodes.columns), commit, gone)
    all_nodes = stage(nodes.unionByName(new_nodes), "merged-nodes")
    # calls whose target is gone for good become calls of a placeholder of its name
    lost = gone.join(all_nodes.select("id"), "id", "left_anti").select(F.col("id").alias("dst"), F.concat(F.lit("call::"), "name").alias("open"))
    ident = lambda *c: F.xxhash64(*c).bitwiseAND(F.lit(2**63 - 1))
    e = edges.join(lost, "dst", "left").where("open is null or kind = 'calls'")
    hit = F.col("open").isNotNull()
    e = e.withColumn("dst", F.when(hit, ident("open")).otherwise(F.col("dst"))).withColumn("conf_class", F.when(hit, "ambiguous").otherwise(F.col("conf_class"))).withColumn("confidence", F.when(hit, 0.0).otherwise(F.col("confidence")))
    kept = stage(e, "kept-edges")
    types = dict(all_nodes.dtypes)
    names = kept.where("open is not null").select("open").distinct()
    values = {"id": ident("open"), "kind": F.lit("function"), "name": F.substr("open", F.lit(7)), "qualified_name": F.col("open"), "is_test": F.lit(False), "valid_from": F.lit(commit)}
    holes = names.select(*[values.get(c, F.lit(None)).cast(types[c]).alias(c) for c in all_nodes.columns])
    holes = holes.join(all_nodes.select("id"), "id", "left_anti").select(*all_nodes.columns)
    stamped = enrich.stamp_birth(fresh.edges.select(*old.edges.columns), commit, old.edges.select("edge_id", "valid_from"), "edge_id")
    merged = kept.select(*old.edges.columns).unionByName(stamped).dropDuplicates(["src", "dst", "kind"])
    g = PropertyGraph(all_nodes.unionByName(holes), merged).with_both_ends()
    g = enrich.apply_resolution(PropertyGraph(g.nodes, g.edges.select(*old.edges.columns)))
    extra = _derived(g, commit)
    store.save(PropertyGraph(stage(g.nodes, "new-nodes"), stage(g.edges.unionByName(extra), "new-edges")))
    store.set_hashes(files.join(changes.where("change <> 'deleted'").select("path"), "path", "left_semi"), now if now is not None else int(time.time()))
    store.write("file_state", store.read("file_state").join(changes.where("change = 'deleted'").select("path"), "path", "left_anti").select("path", "hash", "indexed_at"))
    return changes


def _derived(g: PropertyGraph, commit: str) -> DataFrame:
    """tested_by and mentions edges that the graph lacks."""
    types = dict(g.edges.dtypes)
    rows = enrich.tested_by(g).select("src", "dst", F.lit("tested_by").alias("kind"), F.lit(1.0).alias("confidence"), F.lit("extracted").alias("conf_class"))
    m = enrich.resolve_mentions(enrich.pending_mentions(g.nodes), g)
    rows = rows.unionByName(m.select(F.col("section_id").alias("src"), F.col("node_id").alias("dst"), F.lit("mentions").alias("kind"), "confidence", F.lit("inferred").alias("conf_class")))
    rows = rows.withColumn("edge_id", F.xxhash64("src", "dst", "kind").bitwiseAND(F.lit(2**63 - 1))).withColumn("valid_from", F.lit(commit))
    return rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(types[c]).alias(c) for c in g.edges.columns])
