"""Queries p1 to p4: records and references at scale."""

from __future__ import annotations

from pyspark.sql import functions as F

from knotwork.operators import history, hot_keys, references, snapshot_diff
from knotwork.session import read_table

#: JSON text to a sorted list of its leaves and containers, equal for equal values.
CANONICAL_SQL = """
canon AS (
  SELECT p, CASE WHEN p IS NULL OR trim(p, E' \\t\\r\\n') = '' THEN '' WHEN NOT json_valid(p) THEN 't:' || p
    ELSE (SELECT CASE WHEN count(*) = 1 AND max(j.type) = 'OBJECT' THEN '' ELSE 'v:' || string_agg(
            j.fullkey || CASE WHEN j.type IN ('OBJECT', 'ARRAY') THEN j.type WHEN j.type = 'NULL' THEN '~'
              WHEN j.type = 'VARCHAR' THEN 's' || (j.atom ->> '$') ELSE 'n' || CAST(j.atom AS VARCHAR) END, chr(1) ORDER BY j.fullkey) END
          FROM json_tree(CASE WHEN json_valid(p) THEN p ELSE '{{}}' END) j) END AS c
  FROM (SELECT DISTINCT properties AS p FROM {table})
)"""


def p1_key_counts(spark, folder):
    return hot_keys.salted_counts(read_table(spark, folder, "edges"))


def p1_found(spark, folder):
    return hot_keys.dominant_keys(read_table(spark, folder, "edges"))


def _graph(spark, folder):
    return (read_table(spark, folder, t) for t in ("edges", "nodes", "commits"))


def p2_found(spark, folder):
    return references.orphan_references(*_graph(spark, folder))


def p2_report(spark, folder):
    return references.orphan_report(*_graph(spark, folder))


def p2_classes(spark, folder):
    """Every reference that doesn't hold, also those to nodes that had ended before."""
    return references.classify_references(*_graph(spark, folder)).select("edge_id", "side", "status").distinct()


def p3_history(spark, folder):
    return history.attribute_history(read_table(spark, folder, "node_versions"), read_table(spark, folder, "commits"))


def p3_found(spark, folder):
    return p3_history(spark, folder).select("qualified_name", "valid_from", "valid_to")


#: Numbers of the first full snapshot and of the one that nodes is.
FIRST, LATEST = 1, 4


def p3_spans(spark, folder):
    return p3_history(spark, folder).drop("properties")


def p4_found(spark, folder):
    snapshots = snapshot_diff.stack_snapshots(read_table(spark, folder, "node_snapshots"), read_table(spark, folder, "nodes"), LATEST)
    return snapshot_diff.snapshot_changes(snapshots, FIRST, LATEST)


def p4_summary(spark, folder):
    return p4_found(spark, folder).groupBy("snap_no", "change").agg(F.count("*").alias("n_names"))


QUERIES = {f.__name__: f for f in (p1_found, p1_key_counts, p2_found, p2_report, p2_classes, p3_found, p3_history, p3_spans, p4_found, p4_summary)}

_KEYS = """
keys AS (
  SELECT 'src' AS side, src_id AS node_id, kind, edge_id FROM edges WHERE src_id IS NOT NULL
  UNION ALL SELECT 'dst', dst_id, kind, edge_id FROM edges WHERE dst_id IS NOT NULL
)"""

_ORPHANS = """
refs AS (
  SELECT edge_id, 'src' AS side, src_id AS k, valid_from, ingested_at FROM edges WHERE src_id IS NOT NULL
  UNION ALL SELECT edge_id, 'dst', dst_id, valid_from, ingested_at FROM edges WHERE dst_id IS NOT NULL
), born AS (
  SELECT id, max(coalesce(c.ord, -1)) AS b, CASE WHEN count(d.ord) = count(*) THEN max(d.ord) END AS g
  FROM nodes n LEFT JOIN commits c ON c.sha = n.valid_from LEFT JOIN commits d ON d.sha = n.valid_to GROUP BY id
), bad AS (
  SELECT r.*, CASE WHEN b.id IS NULL THEN 'missing' WHEN b.b > c.ord THEN 'late' END AS status, CASE WHEN b.g < c.ord THEN 'deleted' END AS ended
  FROM refs r LEFT JOIN born b ON b.id = r.k LEFT JOIN commits c ON c.sha = r.valid_from
)"""

_HISTORY = """
recs AS (
  SELECT qualified_name AS q, c.ord AS s, CASE WHEN d.ord >= c.ord THEN d.ord END AS e, properties AS p,
    row_number() OVER (PARTITION BY qualified_name, c.ord ORDER BY recorded_at DESC NULLS LAST, id DESC, d.ord DESC NULLS LAST) AS rn
  FROM node_versions v JOIN commits c ON c.sha = coalesce(valid_from, valid_to) LEFT JOIN commits d ON d.sha = valid_to
  WHERE qualified_name IS NOT NULL
), held AS (
  SELECT q, s, k.c, least(e, lead(s) OVER (PARTITION BY q ORDER BY s) - 1) AS t
  FROM recs LEFT JOIN canon k ON k.p IS NOT DISTINCT FROM recs.p WHERE rn = 1
), broken AS (
  SELECT *, CASE WHEN lag(c) OVER w = c AND NOT lag(t) OVER w + 1 < s THEN 0 ELSE 1 END AS b FROM held WINDOW w AS (PARTITION BY q ORDER BY s)
), islands AS (SELECT *, sum(b) OVER (PARTITION BY q ORDER BY s) AS g FROM broken),
spans AS (SELECT q, min(s) AS f, arg_max(coalesce(t, -1), s) AS t FROM islands GROUP BY q, g)
SELECT q AS qualified_name, {ordinals} a.sha AS valid_from, coalesce(z.sha, '') AS valid_to
FROM spans JOIN commits a ON a.ord = f LEFT JOIN commits z ON z.ord = t"""

_CHANGES = """
snaps AS (
  SELECT snap_no, trim(qualified_name, ' ') AS q, line_start, properties, delivered_at FROM node_snapshots
  UNION ALL SELECT 4, trim(qualified_name, ' '), line_start, properties, delivered_at FROM nodes
), ranked AS (
  SELECT s.*, k.c, row_number() OVER (PARTITION BY snap_no, q ORDER BY delivered_at DESC NULLS LAST, line_start DESC NULLS LAST, k.c DESC) AS rn
  FROM snaps s LEFT JOIN canon k ON k.p IS NOT DISTINCT FROM s.properties WHERE q IS NOT NULL
), cur AS (SELECT * FROM ranked WHERE rn = 1),
changes AS (
  SELECT coalesce(n.snap_no, o.snap_no + 1) AS snap_no, coalesce(n.q, o.q) AS qualified_name,
    CASE WHEN o.q IS NULL THEN 'added' WHEN n.q IS NULL THEN 'removed' ELSE 'changed' END AS change
  FROM (SELECT * FROM cur WHERE snap_no > 1) n FULL JOIN (SELECT * FROM cur WHERE snap_no < 4) o ON o.q = n.q AND o.snap_no + 1 = n.snap_no
  WHERE o.q IS NULL OR n.q IS NULL OR o.line_start IS DISTINCT FROM n.line_start OR o.c <> n.c
)"""

_BOTH = "(SELECT properties FROM node_snapshots UNION ALL SELECT properties FROM nodes)"

ORACLES = {
    "p1_key_counts": f"WITH {_KEYS} SELECT side, node_id, kind, count(*) AS n_rows, count(DISTINCT edge_id) AS n_edges FROM keys GROUP BY ALL",
    "p1_found": f"WITH {_KEYS} SELECT side, node_id FROM keys GROUP BY ALL HAVING count(*) >= 0.01 * (SELECT count(*) FROM edges)",
    "p2_found": f"WITH {_ORPHANS} SELECT DISTINCT edge_id, side FROM bad WHERE status IS NOT NULL",
    "p2_classes": f"WITH {_ORPHANS} SELECT DISTINCT edge_id, side, coalesce(status, ended) AS status FROM bad WHERE coalesce(status, ended) IS NOT NULL",
    "p2_report": f"""WITH {_ORPHANS} SELECT side, CAST(date_trunc('month', ingested_at) AS DATE) AS month, status, count(*) AS n_rows,
        count(DISTINCT edge_id) AS n_edges FROM bad WHERE status IS NOT NULL GROUP BY ALL""",
    "p3_found": f"WITH {CANONICAL_SQL.format(table='node_versions')}, {_HISTORY.format(ordinals='')}",
    "p3_spans": f"WITH {CANONICAL_SQL.format(table='node_versions')}, {_HISTORY.format(ordinals='f AS from_ord, nullif(t, -1) AS to_ord,')}",
    "p4_found": f"WITH {CANONICAL_SQL.format(table=_BOTH)}, {_CHANGES} SELECT snap_no, qualified_name, change FROM changes",
    "p4_summary": f"WITH {CANONICAL_SQL.format(table=_BOTH)}, {_CHANGES} SELECT snap_no, change, count(*) AS n_names FROM changes GROUP BY ALL",
}
