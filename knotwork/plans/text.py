"""Queries over names, texts and vectors: search, similarity, label merging, motifs."""

from __future__ import annotations

from pyspark.sql import functions as F

from knotwork.functions import embedding, names
from knotwork.functions.similarity import jaro_winkler_column
from knotwork.graph import NODE_COLUMNS, PropertyGraph
from knotwork.operators import dedup, motifs, search
from knotwork.plans.structure import G, graph
from knotwork.session import read_table
from knotwork.weights import NODE_WEIGHTS, PRIOR, sql_case

QUERY = "graph loader"
SYMBOL = "index_token"


def identifier_words(spark, folder):
    g = graph(spark, folder)
    return g.nodes.select("qualified_name", names.identifier_words(F.col("name")).alias("words"))


def test_detection(spark, folder):
    g = graph(spark, folder)
    return g.nodes.select("qualified_name", names.is_test_path(F.col("source_uri")).alias("by_path"), names.is_test_name(F.col("name")).alias("by_name"), names.language_of(F.col("source_uri")).alias("language"))


def ranked_search(spark, folder):
    """All hits of a query, without the fuzzy ones, which SQL lacks."""
    hits = search.ranked_search(graph(spark, folder), QUERY, None, fuzzy=False)
    return hits.select("qualified_name", F.round("score", 4).alias("score"))


def fuzzy_search(spark, folder):
    return search.ranked_search(graph(spark, folder), "shedule", None).select("qualified_name", F.round("score", 4).alias("score"))


def _index(spark, folder):
    docs = read_table(spark, folder, "documents").where("text is not null")
    return search.build_index(docs, "doc_id", F.col("text"))


def bm25_search(spark, folder):
    return search.bm25(*_index(spark, folder), "doc_id", QUERY).withColumn("score", F.round("score", 5))


def index_terms(spark, folder):
    postings, _ = _index(spark, folder)
    return postings.groupBy("term").agg(F.count("*").alias("documents"), F.sum("tf").alias("occurrences"))


def vector_topk(spark, folder):
    """Every vector with a cosine of at least 0.2 to that of the least id."""
    e = read_table(spark, folder, "embeddings")
    first = e.orderBy("vec_id").first()
    scored = search.vector_search(e, "vec_id", "embedding", list(first.embedding) if first else [])
    return scored.withColumn("score", F.round("score", 6))


def related(spark, folder):
    e = read_table(spark, folder, "embeddings")
    first = e.agg(F.min("vec_id")).first()[0]
    return search.related(e, "vec_id", "embedding", first).withColumn("score", F.round("score", 6))


def rrf_fusion(spark, folder):
    """Names and qualified names as two lists, fused by reciprocal ranks."""
    g = graph(spark, folder)
    d = g.degrees().where("degree > 0")
    lists = [(d.select("id", F.col(c).cast("double").alias("score")).orderBy(F.desc("score"), "id").limit(60), w) for c, w in (("in_degree", search.TEXT_WEIGHT), ("out_degree", search.VECTOR_WEIGHT))]
    return search.reciprocal_ranks(lists, "id").select(F.col("id").alias("node_id"), F.round("score", 6).alias("score"))


def source_saturation(spark, folder):
    g = graph(spark, folder)
    hits = g.degrees().where("degree > 0").join(g.nodes.select("id", "source_uri"), "id").select("id", "source_uri", F.col("degree").cast("double").alias("score"))
    return search.saturated(hits).select(F.col("id").alias("node_id"), F.round("score", 6).alias("score"))


def hybrid_search(spark, folder):
    g = graph(spark, folder)
    index = search.build_index(g.nodes, "id", F.concat_ws(" ", "kind", "name", "qualified_name"))
    return search.hybrid_search(g, SYMBOL, 20, index).select("qualified_name", F.round("score", 4).alias("score"))


def embed_nodes(spark, folder):
    g = PropertyGraph.load(spark, folder, (*NODE_COLUMNS, "source_text"))
    return embedding.embed_nodes(g.nodes)


def label_normalize(spark, folder):
    g = graph(spark, folder)
    return g.nodes.where(F.col("kind").isin(*dedup.KINDS)).select("qualified_name", dedup.normalised_label(F.col("name")).alias("label"))


def entropy_gate(spark, folder):
    g = graph(spark, folder)
    n = g.nodes.where("name is not null").select("qualified_name", F.lower("name").alias("t"))
    return n.select("qualified_name", F.round(dedup.entropy(F.col("t")), 6).alias("entropy"), dedup.passes_entropy_gate(F.col("t")).alias("passes"))


def jaro_winkler_pairs(spark, folder):
    """Pairs of sections or concepts of one source with similar names."""
    n = graph(spark, folder).nodes.where("kind in ('section', 'concept') and source_uri is not null and name is not null")
    n = n.select("source_uri", "id", dedup.normalised_label(F.col("name")).alias("t"))
    j = n.withColumnsRenamed({"id": "a", "t": "ta"}).join(n.withColumnsRenamed({"id": "b", "t": "tb"}), "source_uri").where("a < b")
    return j.select("a", "b", F.round(jaro_winkler_column(F.col("ta"), F.col("tb")), 6).alias("similarity"))


def lsh_pairs(spark, folder):
    n = graph(spark, folder).nodes.where(F.col("kind").isin(*dedup.KINDS) & F.col("name").isNotNull())
    return dedup.candidate_pairs(n.select("id", F.col("name").alias("label"))).select("a", "b")


def dedup_components(spark, folder):
    g = graph(spark, folder)
    return dedup.merge_map(g, dedup.duplicate_pairs(g))


def dedup_graph(spark, folder):
    """Edges between what is left after the merge."""
    g, _ = dedup.deduplicate(graph(spark, folder))
    return g.edges.select("edge_id", "src", "dst", "kind")


def motif_pair(spark, folder):
    """Methods that call a class."""
    m = motifs.Motif().node(0, kind="method").node(1, kind="class").edge(0, 1, "calls")
    return motifs.find_motifs(graph(spark, folder), m)


def motif_security(spark, folder):
    m = motifs.Motif().node(0, kind="function", name="load", match="contains").node(1, kind="function").edge(0, 1, "calls")
    return motifs.find_motifs(graph(spark, folder), m)


def motif_diamond(spark, folder):
    """Two callees of one function that call the same third."""
    m = motifs.Motif().node(0, kind="function").node(1).node(2).node(3)
    for s, t in ((0, 1), (0, 2), (1, 3), (2, 3)):
        m = m.edge(s, t, "calls")
    return motifs.find_motifs(graph(spark, folder), m)


def _built_in(name):
    def run(spark, folder):
        return motifs.find_motifs(graph(spark, folder), motifs.BUILT_IN[name])

    run.__name__ = f"motif_{name}"
    return run


def motif_triangle(spark, folder):
    m = motifs.Motif().node(0, min_degree=5).node(1).node(2).edge(0, 1, "calls").edge(1, 2, "calls").edge(0, 2, "calls")
    return motifs.find_motifs(graph(spark, folder), m)


QUERIES = {f.__name__: f for f in (identifier_words, test_detection, ranked_search, fuzzy_search, bm25_search, index_terms, vector_topk, related, rrf_fusion, source_saturation, hybrid_search, embed_nodes, label_normalize, entropy_gate, jaro_winkler_pairs, lsh_pairs, dedup_components, dedup_graph, motif_pair, motif_security, motif_diamond, motif_triangle, *map(_built_in, motifs.BUILT_IN))}

_D = "d AS (SELECT n.id, n.source_uri, coalesce(i.c, 0) AS ind, coalesce(o.c, 0) AS outd, coalesce(i.c, 0) + coalesce(o.c, 0) AS deg FROM n LEFT JOIN (SELECT dst, count(*) AS c FROM e GROUP BY 1) i ON i.dst = n.id LEFT JOIN (SELECT src, count(*) AS c FROM e GROUP BY 1) o ON o.src = n.id)"
_KINDS = ", ".join(f"'{k}'" for k in dedup.KINDS)
_NOISE = "least(" + ", ".join([f"CASE WHEN regexp_matches(source_uri, '{names.TEST_PATH}') THEN {search.TEST_FACTOR} ELSE 1 END", *[f"CASE WHEN regexp_matches(lower(source_uri), '{p}') THEN {f} ELSE 1 END" for p, f in search.NOISE]]) + ")"
_TERMS = "t AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS term FROM documents WHERE text IS NOT NULL)"
_W = ["graph", "loader"]
_LABEL = """regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(nfc_normalize(name)), '\\b[vV]?[ _]?\\d+\\.?\\d*$', ''), '([a-zA-Z_])[ _]?\\d+$', '\\1'), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"""


def _pattern(nodes: dict[str, str], edges: list[tuple[str, str, str]]) -> str:
    froms = ", ".join([f"(SELECT DISTINCT src, dst FROM e WHERE kind = '{k}') {s}{t}" for s, t, k in edges] + [f"m {x}" for x in nodes])
    where = [f"{s}{t}.src = {s}.id AND {s}{t}.dst = {t}.id" for s, t, _ in edges] + [f"{a}.id <> {b}.id" for i, a in enumerate(nodes) for b in list(nodes)[i + 1 :]]
    where += [c.replace("@", f"{x}.") for x, c in nodes.items() if c]
    return f"WITH {G}, {_D}, m AS (SELECT n.id, kind, name, deg FROM n JOIN d USING (id)) SELECT " + ", ".join(f"{x}.id AS n{i}" for i, x in enumerate(nodes)) + f" FROM {froms} WHERE " + " AND ".join(where)


ORACLES = {
    "identifier_words": f"WITH {G} SELECT qualified_name, {names.identifier_words_sql('name')} AS words FROM n",
    "test_detection": f"WITH {G} SELECT qualified_name, coalesce(regexp_matches(source_uri, '{names.TEST_PATH}'), false) AS by_path, coalesce(regexp_matches(name, '{names.TEST_NAME}'), false) AS by_name, {names.language_sql('source_uri')} AS language FROM n",
    "ranked_search": f"""WITH {G}, {_D}, w AS (SELECT n.id, qualified_name, kind, n.source_uri, deg, coalesce({names.identifier_words_sql('name')}, '') AS a, coalesce({names.identifier_words_sql("replace(qualified_name, '::', ' ')")}, '') AS b FROM n JOIN d USING (id)),
        s AS (SELECT *, CASE WHEN a = '{QUERY}' OR lower(qualified_name) = '{QUERY}' THEN 100 ELSE 0 END + CASE WHEN starts_with(a, '{QUERY}') THEN 35 ELSE 0 END + CASE WHEN contains(a, '{QUERY}') OR contains(b, '{QUERY}') THEN 20 ELSE 0 END
          + 8.0 * ({" + ".join(f"(contains(a, '{x}') OR contains(b, '{x}'))::INT" for x in _W)}) / {len(_W)} AS s0 FROM w),
        r AS (SELECT *, (s0 + least(4, ln(1 + deg)) + {sql_case('kind', NODE_WEIGHTS, PRIOR, 0.5)}) * coalesce({_NOISE}, 1) AS s1 FROM s WHERE s0 > 0)
        SELECT qualified_name, round(CASE WHEN source_uri IS NULL THEN s1 ELSE s1 * pow(0.72, row_number() OVER (PARTITION BY source_uri ORDER BY s1 DESC, id) - 1) END, 4) AS score FROM r""",
    "bm25_search": f"""WITH {_TERMS}, l AS (SELECT doc_id, count(*) AS len FROM t GROUP BY 1), q AS (SELECT unnest({_W!r}) AS word), f AS (SELECT doc_id, word, count(*) AS tf FROM t JOIN q ON starts_with(term, word) GROUP BY 1, 2),
        df AS (SELECT word, count(*) AS df FROM f GROUP BY 1), g AS (SELECT count(*) AS n, avg(len) AS m FROM l)
        SELECT doc_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / m))), 5) AS score FROM f JOIN df USING (word) JOIN l USING (doc_id), g GROUP BY 1 HAVING count(*) = {len(_W)}""",
    "index_terms": f"WITH {_TERMS}, p AS (SELECT term, doc_id, count(*) AS tf FROM t GROUP BY 1, 2) SELECT term, count(*) AS documents, sum(tf)::BIGINT AS occurrences FROM p GROUP BY 1",
    "vector_topk": """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings), q AS (SELECT x AS y FROM v ORDER BY vec_id LIMIT 1)
        SELECT * FROM (SELECT vec_id, round(list_cosine_similarity(x, y), 6) AS score, list_cosine_similarity(x, y) AS s FROM v, q) WHERE s >= 0.2""".replace("SELECT * FROM (SELECT", "SELECT vec_id, score FROM (SELECT"),
    "related": """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings), q AS (SELECT vec_id AS k, x AS y FROM v ORDER BY vec_id LIMIT 1)
        SELECT vec_id, round(list_cosine_similarity(x, y), 6) AS score FROM v, q WHERE vec_id <> k AND list_cosine_similarity(x, y) > 0""",
    "rrf_fusion": f"""WITH {G}, {_D}, a AS (SELECT id, row_number() OVER (ORDER BY ind DESC, id) AS r FROM d WHERE deg > 0), b AS (SELECT id, row_number() OVER (ORDER BY outd DESC, id) AS r FROM d WHERE deg > 0)
        SELECT id AS node_id, round(sum(p), 6) AS score FROM (SELECT id, 3600.0 / (60 + r) AS p FROM a WHERE r <= 60 UNION ALL SELECT id, 2700.0 / (60 + r) FROM b WHERE r <= 60) GROUP BY 1""",
    "source_saturation": f"WITH {G}, {_D} SELECT id AS node_id, round(CASE WHEN source_uri IS NULL THEN deg ELSE deg * pow(0.72, row_number() OVER (PARTITION BY source_uri ORDER BY deg DESC, id) - 1) END, 6) AS score FROM d WHERE deg > 0",
    "label_normalize": f"WITH {G} SELECT qualified_name, CASE WHEN {_LABEL} = '' THEN name ELSE {_LABEL} END AS label FROM n WHERE kind IN ({_KINDS})",
    "entropy_gate": f"""WITH {G}, c AS (SELECT qualified_name, id, lower(name) AS t FROM n WHERE name IS NOT NULL), s AS (SELECT id, unnest(string_split(t, '')) AS ch, length(t) AS n FROM c WHERE t <> ''),
        h AS (SELECT id, -sum(k / n * log2(k / n)) AS h, count(*) AS u FROM (SELECT id, ch, any_value(n) AS n, count(*) AS k FROM s GROUP BY 1, 2) GROUP BY 1)
        SELECT qualified_name, round(coalesce(h, 0), 6) AS entropy, CASE WHEN length(t) < 3 THEN true WHEN length(t) <= 5 AND u <= 3 THEN false ELSE coalesce(h, 0) >= 0.5 END AS passes FROM c LEFT JOIN h USING (id)""",
    "jaro_winkler_pairs": f"""WITH {G}, m AS (SELECT source_uri, id, CASE WHEN {_LABEL} = '' THEN name ELSE {_LABEL} END AS t FROM n WHERE kind IN ('section', 'concept') AND source_uri IS NOT NULL AND name IS NOT NULL)
        SELECT x.id AS a, y.id AS b, round(jaro_winkler_similarity(x.t, y.t), 6) AS similarity FROM m x JOIN m y ON x.source_uri = y.source_uri AND x.id < y.id""",
    "motif_pair": _pattern({"a": "@kind = 'method'", "b": "@kind = 'class'"}, [("a", "b", "calls")]),
    "motif_security": _pattern({"a": "@kind = 'function' AND contains(lower(@name), 'load')".replace("@name", "a.name"), "b": "@kind = 'function'"}, [("a", "b", "calls")]),
    "motif_diamond": _pattern({"a": "@kind = 'function'", "b": "", "c": "", "z": ""}, [("a", "b", "calls"), ("a", "c", "calls"), ("b", "z", "calls"), ("c", "z", "calls")]),
    "motif_security_audit": _pattern({"a": "@kind = 'function' AND contains(lower(a.name), 'sql')", "b": "@kind = 'function'"}, [("a", "b", "calls")]),
    "motif_diamond_inheritance": _pattern({x: "@kind = 'class'" for x in "abcz"}, [("a", "b", "inherits"), ("a", "c", "inherits"), ("b", "z", "inherits"), ("c", "z", "inherits")]),
    "motif_doc_triangle": _pattern({"a": "@kind = 'document'", "b": "@kind = 'section'", "c": "@kind = 'function'"}, [("a", "b", "defines"), ("b", "c", "mentions"), ("a", "c", "describes")]),
    "motif_triangle": _pattern({"x": "@deg >= 5", "y": "", "z": ""}, [("x", "y", "calls"), ("y", "z", "calls"), ("x", "z", "calls")]),
}
