"""Queries p5 to p9. SQL can't express most of their operators; tests hold them against brute force instead."""

from __future__ import annotations

from pyspark.sql import functions as F

from knotwork.llm import encoding, language, neardup, neighbours, packing
from knotwork.session import read_table


def p5_found(spark, folder):
    return neighbours.nearest_pairs(read_table(spark, folder, "node_vectors"))


def p5_neighbours(spark, folder):
    return neighbours.nearest_nodes(read_table(spark, folder, "node_vectors"))


def p6_found(spark, folder):
    return neardup.near_duplicate_pairs(read_table(spark, folder, "nodes"))


def p6_groups(spark, folder):
    return neardup.near_duplicate_groups(read_table(spark, folder, "nodes"))


def p7_ids(spark, folder):
    return encoding.encode_corpus(read_table(spark, folder, "documents"))


def p8_pack(spark, folder):
    return packing.pack_documents(read_table(spark, folder, "documents"))


def p8_fill(spark, folder):
    """How full the containers are: one row per fill in tokens."""
    fill = p8_pack(spark, folder).groupBy("container").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("parts"))
    return fill.groupBy("tokens").agg(F.count("*").alias("containers"), F.sum("parts").alias("parts"))


def _texts(spark, folder):
    return read_table(spark, folder, "documents"), read_table(spark, folder, "lang_samples")


def p9_found(spark, folder):
    return language.wrong_labels(*_texts(spark, folder))


def p9_paragraphs(spark, folder):
    return language.paragraph_languages(*_texts(spark, folder))


def p9_segments(spark, folder):
    return language.segment_languages(*_texts(spark, folder))


def p9_documents(spark, folder):
    return language.document_languages(*_texts(spark, folder))


QUERIES = {f.__name__: f for f in (p5_found, p5_neighbours, p6_found, p6_groups, p7_ids, p8_pack, p8_fill, p9_found, p9_paragraphs, p9_segments, p9_documents)}

#: Exact 5-grams. Similar contents share one of their rarest 0.4 n + 1 grams, so only contents that do are compared.
_ALIKE = r"""
c AS (SELECT DISTINCT id, trim(regexp_replace(lower(coalesce(name, '') || ' ' || coalesce(source_text, '')), '[ \t\r\n]+', ' ', 'g')) AS content FROM nodes WHERE id IS NOT NULL),
d AS (SELECT id, content FROM c WHERE length(content) >= 24),
k AS MATERIALIZED (SELECT content, min(id) AS class_id, list_distinct(list_transform(range(1, length(content) - 3), lambda i: substr(content, i, 5))) AS g FROM d GROUP BY 1),
u AS MATERIALIZED (SELECT class_id, len(g) AS n, unnest(g) AS gram FROM k),
f AS (SELECT gram, count(*) AS holders FROM u GROUP BY 1),
p AS MATERIALIZED (SELECT class_id, n, gram FROM (SELECT u.*, row_number() OVER (PARTITION BY class_id ORDER BY holders, gram) AS r FROM u JOIN f USING (gram)) WHERE r <= floor(0.4 * n + 1e-9) + 1),
q AS MATERIALIZED (SELECT DISTINCT x.class_id AS a, y.class_id AS b FROM p x JOIN p y ON x.gram = y.gram AND x.class_id < y.class_id AND y.n >= 0.6 * x.n AND x.n >= 0.6 * y.n),
o AS (SELECT a, b, len(x.g) + len(y.g) AS n, len(list_intersect(x.g, y.g)) AS common FROM q JOIN k x ON x.class_id = a JOIN k y ON y.class_id = b),
alike AS MATERIALIZED (SELECT a, b FROM o WHERE common / (n - common) >= 0.6),
m AS (SELECT d.id, k.class_id FROM d JOIN k USING (content))"""

ORACLES: dict[str, str] = {
    "p6_found": f"""WITH {_ALIKE}, ends AS (SELECT a, b FROM alike UNION ALL SELECT DISTINCT class_id, class_id FROM m)
        SELECT DISTINCT least(x.id, y.id) AS id_a, greatest(x.id, y.id) AS id_b FROM ends JOIN m x ON x.class_id = a JOIN m y ON y.class_id = b WHERE x.id <> y.id""",
    "p6_groups": f"""WITH {_ALIKE}, l AS (SELECT class_id, count(*) AS n FROM (SELECT a AS class_id FROM alike UNION ALL SELECT b FROM alike) GROUP BY 1)
        SELECT id, class_id, coalesce(n, 0)::BIGINT AS n_links FROM m LEFT JOIN l USING (class_id)""",
}
