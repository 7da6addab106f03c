"""Queries over documents as files, diffs, sinks and event streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from knotwork.plans.code import by_folder
from knotwork.plans.structure import G, graph
from knotwork.session import read_table, shared_dir
from knotwork.sources import sinks
from knotwork.sources.extract import assemble, build, extract_rows
from knotwork.streaming import events as ev


def _documents_as_files(spark, folder):
    """Every document with a text; its ending follows the markup, and prose of any kind is read as Markdown."""
    d = read_table(spark, folder, "documents").where("text is not null")
    ending = F.when(F.col("text").rlike(r"(?i)^\s*(<\?xml[^>]*>\s*)?<svg\b"), ".svg").when(F.col("text").rlike(r"(?i)^\s*<(!doctype html|html)\b"), ".html").otherwise(".md")
    return d.select(F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), ending).alias("path"), F.col("text").alias("content"))


def _sources_as_files(spark, folder):
    """The source text of each code file's functions and classes, in line order, as one file."""
    g = graph(spark, folder, "source_text")
    n = g.nodes.where("source_uri is not null and source_text is not null")
    return n.groupBy(F.col("source_uri").alias("path")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_start", "id", "source_text"))), lambda x: x["source_text"]), "\n\n").alias("content"))


def markdown_sections(spark, folder):
    rows = extract_rows(_documents_as_files(spark, folder))
    return rows.where("what = 'node'").select("qualified_name", "kind", "line_start").distinct()


def extract_code(spark, folder):
    g = assemble(extract_rows(_sources_as_files(spark, folder)))
    return g.nodes.select("qualified_name", "kind", "line_start", "line_end", "is_test")


def build_graph(spark, folder):
    files = _sources_as_files(spark, folder).unionByName(_documents_as_files(spark, folder))
    return build(files, "c0").edges.select("src", "dst", "kind", "conf_class", "resolved_from")


def graphml(spark, folder):
    g = graph(spark, folder)
    return sinks.graphml_lines(g, by_folder(g))


def session_debounce(spark, folder):
    """Bursts of each user's events with less than six hours between them."""
    e = read_table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    s = ev.sessions(e, "6 hours")
    return s.select("user_id", F.unix_micros("started").alias("started_us"), "events")


def hourly_events(spark, folder):
    e = read_table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    t = ev.tumbling(e, "1 hour")
    return t.select(F.unix_micros("started").alias("started_us"), "event_type", "events", F.round("total", 4).alias("total"))


def streamed_hours(spark, folder):
    """The same windows by a stream over the table's files, run to its end."""
    path = f"{folder}/events.parquet"
    import uuid

    name, schema = f"hours_{uuid.uuid4().hex}", spark.read.parquet(path).schema
    ev.run_available(ev.tumbling(spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path if _is_folder(spark, path) else folder + "/events*.parquet").withColumn("ts", F.col("ts").cast("timestamp")), "1 hour"), name, f"{shared_dir(spark)}/{name}", "complete")
    return spark.table(name).select(F.unix_micros("started").alias("started_us"), "event_type", "events", F.round("total", 4).alias("total"))


def _is_folder(spark, path):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


QUERIES = {f.__name__: f for f in (markdown_sections, extract_code, build_graph, graphml, session_debounce, hourly_events, streamed_hours)}

_HOURS = "SELECT epoch_us(date_trunc('hour', ts)) AS started_us, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"
_ESC = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')"


def _data(keys, prefix, sources):
    return " || ".join(f"coalesce('<data key=\"{prefix}{k}\">' || {_ESC.format(s)} || '</data>', '')" for k, s in zip(keys, sources))


_KEYS_XML = "".join(f'<key id="{p}{k}" for="{w}" attr.name="{k}" attr.type="string"/>' for p, w, ks in (("n_", "node", sinks._NODE_KEYS), ("e_", "edge", sinks._EDGE_KEYS)) for k in ks)
ORACLES = {
    "hourly_events": _HOURS,
    "streamed_hours": _HOURS,
    "session_debounce": """WITH m AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, b DESC ROWS UNBOUNDED PRECEDING) AS g FROM m) SELECT user_id, epoch_us(min(ts)) AS started_us, count(*) AS events FROM s GROUP BY user_id, g""",
    "graphml": f"""WITH {G} SELECT 0 AS part, '{sinks._HEAD}{_KEYS_XML}<graph edgedefault="directed">' AS line UNION ALL SELECT 3, '</graph></graphml>'
        UNION ALL SELECT 1, '<node id="n' || id || '">' || {_data(sinks._NODE_KEYS, 'n_', ('kind', 'name', 'qualified_name', 'source_uri', "regexp_extract(source_uri, '^([^/]*)/', 1)"))} || '</node>' FROM n
        UNION ALL SELECT 2, '<edge source="n' || src || '" target="n' || dst || '">' || {_data(sinks._EDGE_KEYS, 'e_', ('kind', 'CAST(confidence AS VARCHAR)'))} || '</edge>' FROM e""",
}
