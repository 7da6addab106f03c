"""From files to a property graph: scan, extract in parallel, merge by qualified name."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.graph import PropertyGraph
from knotwork.operators import enrich
from knotwork.operators.communities import detect
from knotwork.operators.dedup import deduplicate
from knotwork.session import discard, stage
from knotwork.sources import code, markup
from knotwork.sources.registry import IgnoreRules, is_relevant, language_of_path, load_registry

ROW = "what string, file_order bigint, kind string, name string, qualified_name string, source_uri string, line_start int, line_end int, is_test boolean, properties string, source_text string, src string, dst string, confidence double, conf_class string, call_scope string, call_receiver string"
_KINDS = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64()}
_ARROW = pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in ROW.split(", ")])


def scan_files(spark: SparkSession, root: str, ignore: IgnoreRules | None = None) -> DataFrame:
    """(path, content, hash) of the relevant files below a folder, read in parallel; paths are relative to it."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/")
    relevant = F.udf(lambda p: is_relevant(p, ignore), "boolean")
    path = F.regexp_replace(F.regexp_replace(F.col("path"), "^file:/*", "/"), "^" + base.replace(".", r"\.") + "/", "")
    files = raw.select(path.alias("path"), "content")
    return files.where(relevant("path")).select("path", F.decode("content", "UTF-8").alias("content"), F.sha2("content", 256).alias("hash"))


def extract_rows(files: DataFrame, overlay: str | None = None) -> DataFrame:
    """Node and edge rows (``what`` says which) of files (path, content); unknown kinds of file give none."""
    registry = load_registry(overlay)

    def one(path: str, text: str):
        language = language_of_path(path, registry)
        if language == "python":
            return code.extract_python(path, text)
        if language in ("rust", "typescript", "cpp"):
            return code.extract_braces(path, text, language)
        if language in registry:
            return code.extract_lines(path, text, registry[language])
        own = {"markdown": markup.extract_markdown, "html": markup.extract_html, "svg": markup.extract_svg}.get(language)
        return own(path, text) if own else ([], [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, text in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                nodes, edges = one(path, text or "")
                out = [{"what": "node", "file_order": i, **n} for i, n in enumerate(nodes)]
                out += [{"what": "edge", "file_order": i, "source_uri": path, **e} for i, e in enumerate(edges)]
                yield from pa.Table.from_pylist(out, schema=_ARROW).to_batches()

    return files.select("path", "content").mapInArrow(run, ROW)


def assemble(rows: DataFrame) -> PropertyGraph:
    """The graph of extracted rows: nodes merged by qualified name, edges by (src, dst, kind), ids by hash.

    Of several rows of a name, that of the first file and place wins. Ids are 63-bit hashes of names, so equal
    in every run. Self loops are dropped.
    """
    rows = stage(rows, "extracted")
    first = F.struct("source_uri", "file_order")
    keep = ["kind", "name", "source_uri", "line_start", "line_end", "is_test", "properties", "source_text"]
    ident = lambda *c: F.xxhash64(*c).bitwiseAND(F.lit(2**63 - 1))
    nodes = rows.where("what = 'node'").groupBy("qualified_name").agg(F.min_by(F.struct(*keep), F.struct(F.col("source_uri").isNull().alias("n"), first.alias("f"))).alias("r"))
    nodes = nodes.select(ident("qualified_name").alias("id"), "r.kind", "r.name", "qualified_name", *[f"r.{c}" for c in keep[2:]])
    e = rows.where("what = 'edge' and src <> dst").groupBy("src", "dst", "kind").agg(F.min_by(F.struct("confidence", "conf_class", "call_scope", "call_receiver"), first).alias("r"))
    edges = e.select(ident("src", "dst", "kind").alias("edge_id"), ident("src").alias("src"), ident("dst").alias("dst"), "kind", "r.*", F.lit(None).cast("string").alias("resolved_from"))
    none = F.lit(None).cast("string")
    # stored, as each later step would group the rows with all their texts anew
    nodes = stage(nodes.withColumn("valid_from", none).withColumn("valid_to", none), "assembled-nodes")
    edges = stage(PropertyGraph(nodes, edges.withColumn("valid_from", none).withColumn("valid_to", none)).with_both_ends().edges, "assembled-edges")
    discard(rows)
    return PropertyGraph(nodes, edges)


def build(files: DataFrame, commit: str | None = None, overlay: str | None = None, merge_labels: bool = False) -> PropertyGraph:
    """Extract, resolve calls, link mentions, derive tested_by and stamp the birth commit.

    With ``merge_labels`` nearly equal labels are merged, those of one Leiden community more readily.
    """
    g = enrich.apply_resolution(assemble(extract_rows(files, overlay)))
    types = dict(g.edges.dtypes)
    ident = lambda kind: F.xxhash64("src", "dst", F.lit(kind)).bitwiseAND(F.lit(2**63 - 1))
    known = lambda kind, conf, score: {"edge_id": ident(kind), "src": F.col("src"), "dst": F.col("dst"), "kind": F.lit(kind), "confidence": score, "conf_class": F.lit(conf)}
    shaped = lambda df, values: df.select(*[values.get(c, F.lit(None)).cast(types[c]).alias(c) for c in g.edges.columns])
    mentions = enrich.resolve_mentions(enrich.pending_mentions(g.nodes), g).select(F.col("section_id").alias("src"), F.col("node_id").alias("dst"), F.col("confidence").alias("score"))
    g = PropertyGraph(g.nodes, g.edges.unionByName(shaped(mentions, known("mentions", "inferred", F.col("score")))))
    g = PropertyGraph(g.nodes, g.edges.unionByName(shaped(enrich.tested_by(g), known("tested_by", "extracted", F.lit(1.0)))))
    if merge_labels:
        g, _ = deduplicate(g, detect(g))
    if commit:
        g = PropertyGraph(enrich.stamp_birth(g.nodes, commit), enrich.stamp_birth(g.edges, commit, key="edge_id"))
    return g
