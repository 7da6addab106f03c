"""Ranked name search, text index with BM25, vector search, and their fusion."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotwork.functions.embedding import embed
from knotwork.functions.names import compact, identifier_words, identifier_words_text, is_test_path, path_stem
from knotwork.functions.similarity import fuzzy_column
from knotwork.graph import PropertyGraph, is_placeholder
from knotwork.weights import PRIOR, node_weight

#: Words of a query that say nothing about a file's name.
STOP_WORDS = ("and", "are", "for", "from", "has", "have", "how", "the", "what", "when", "where", "who", "why", "with")
#: Words of a query that ask for what is usually noise.
PRESERVING = ("test", "tests", "testing", "spec", "specs", "example", "examples", "sample", "samples", "legacy", "compat", "generated", "declaration", "types")
#: Factors of noisy paths.
NOISE = ((r"\.d\.ts$", 0.70), (r"(^|/)(examples|sample)/", 0.82), (r"(^|/)(legacy|compat|generated)/", 0.78))
TEST_FACTOR = 0.72
DEFINITIONS = ("function", "method", "class", "type", "trait", "impl", "module")
SATURATION = 0.72
RRF_K = 60
TEXT_WEIGHT, VECTOR_WEIGHT = 3600.0, 2700.0


def query_identifiers(query: str) -> list[str]:
    """Normalised words of a query that are shaped like identifiers, in order, once each."""
    out: list[str] = []
    for token in re.split(r"[^\w.:]+", query):
        token = token.strip(".:_")
        letters = [c for c in token if c.isalpha()]
        shaped = "_" in token or "." in token or "::" in token or (letters and letters[0].isupper() and any(c.isupper() for c in letters[1:]))
        words = identifier_words_text(token.replace("::", " "))
        if len(token) >= 3 and letters and shaped and words and words not in out:
            out.append(words)
    return out


def noise_factor(source: Column, query: str) -> Column:
    if set(identifier_words_text(query).split()) & set(PRESERVING):
        return F.lit(1.0)
    low = F.lower(source)
    factors = [F.when(is_test_path(source), TEST_FACTOR).otherwise(1.0), *[F.when(low.rlike(p), f).otherwise(1.0) for p, f in NOISE]]
    return F.when(source.isNull(), 1.0).otherwise(F.least(*factors))


def saturated(hits: DataFrame) -> DataFrame:
    """Scores of hits (id, source_uri, score): the k-th best of a source times 0.72^k; null sources are exempt."""
    place = F.row_number().over(Window.partitionBy("source_uri").orderBy(F.desc("score"), "id")) - 1
    return hits.withColumn("score", F.when(F.col("source_uri").isNull(), F.col("score")).otherwise(F.col("score") * F.pow(F.lit(SATURATION), place)))


def _name_scores(graph: PropertyGraph, query: str, fuzzy: bool) -> DataFrame:
    q = identifier_words_text(query)
    tokens, identifiers = q.split(), query_identifiers(query)
    n = graph.nodes.select("id", "kind", "name", "qualified_name", "source_uri")
    n = n.withColumn("words", F.coalesce(identifier_words(F.col("name")), F.lit(""))).withColumn("path_words", F.coalesce(identifier_words(F.replace("qualified_name", F.lit("::"), F.lit(" "))), F.lit("")))
    both = lambda text: F.col("words").contains(text) | F.col("path_words").contains(text)
    share = lambda texts: sum((both(t).cast("double") for t in texts), F.lit(0.0)) / max(1, len(texts))
    exact = F.when((F.col("words") == q) | (F.lower("qualified_name") == query.lower()), 100.0).otherwise(0.0)
    cheap = exact + F.when(F.col("words").startswith(q), 35.0).otherwise(0.0) + F.when(both(q), 20.0).otherwise(0.0) + 8.0 * share(tokens)
    n = n.withColumn("score", F.coalesce(cheap + 45.0 * share(identifiers), F.lit(0.0)))
    hit = n.where("score > 0")
    if fuzzy:  # a frame of its own, so that the slow function sees unmatched names only
        score = fuzzy_column(q)
        near = n.where((F.col("score") <= 0) & (F.length("words") >= len(q))).withColumn("near", score("words", "path_words"))
        hit = hit.unionByName(near.where("near >= 0.58").withColumn("score", F.col("near") * 28.0).drop("near"))
    return hit


def ranked_search(graph: PropertyGraph, query: str, limit: int | None = 20, fuzzy: bool = True) -> DataFrame:
    """(id, qualified_name, kind, source_uri, score), best first; ties by qualified name.

    Exact, prefix, substring, token and identifier matches add up; names that match in none of these ways get a
    fuzzy score. Then come min(4, ln(1 + degree)), the kind's prior, a factor for noisy paths, and the
    saturation of sources. An empty query finds nothing.
    """
    if not identifier_words_text(query):
        return graph.nodes.limit(0).select("id", "qualified_name", "kind", "source_uri", F.lit(0.0).alias("score"))
    hit = _name_scores(graph, query, fuzzy).join(graph.degrees().select("id", "degree"), "id")
    score = (F.col("score") + F.least(F.lit(4.0), F.log1p("degree")) + node_weight(F.col("kind"), PRIOR)) * noise_factor(F.col("source_uri"), query)
    hit = saturated(hit.withColumn("score", score).where("score > 0")).select("id", "qualified_name", "kind", "source_uri", "score")
    return hit if limit is None else hit.orderBy(F.desc("score"), "qualified_name").limit(limit)


# ---- text index ----------------------------------------------------------------------------------


def index_terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def build_index(items: DataFrame, key: str, text: Column) -> tuple[DataFrame, DataFrame]:
    """(postings, lengths): (term, key, tf) and (key, length). One shuffle, of counts combined per task."""
    terms = items.select(key, index_terms(text).alias("terms"))
    postings = terms.select(key, F.explode("terms").alias("term")).groupBy("term", key).agg(F.count("*").alias("tf"))
    return postings, terms.select(key, F.size("terms").alias("length")).where("length > 0")


def bm25(postings: DataFrame, lengths: DataFrame, key: str, query: str, prefix: bool = True, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, score) of items holding every word of the query, each as the start of a term or as a whole.

    Higher is better. A word's frequency is that of all terms it matches; its document frequency counts items.
    """
    words = list(dict.fromkeys(w for w in re.split(r"[^\w]+|_", query.lower()) if w))
    if not words:
        return postings.limit(0).select(key, F.lit(0.0).alias("score"))
    match = lambda w: F.col("term").startswith(w) if prefix else F.col("term") == w
    any_word = match(words[0])
    for w in words[1:]:
        any_word = any_word | match(w)
    asked = F.filter(F.array(*[F.when(match(w), F.lit(i)) for i, w in enumerate(words)]), lambda x: x.isNotNull())
    tf = postings.where(any_word).select(key, "tf", F.explode(asked).alias("word")).groupBy(key, "word").agg(F.sum("tf").alias("tf"))
    df = tf.groupBy("word").agg(F.count("*").alias("df"))  # a row per word of the query
    whole = lengths.agg(F.count("*").alias("n"), F.avg("length").alias("mean"))  # one row
    j = tf.join(F.broadcast(df), "word").join(lengths, key).join(F.broadcast(whole))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    return j.groupBy(key).agg(F.sum(part).alias("score"), F.count("*").alias("words")).where(F.col("words") == len(words)).select(key, "score")


# ---- vectors -------------------------------------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 where lengths differ or a norm is 0."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / F.when(norm > 0, norm)).otherwise(0.0)


def vector_search(vectors: DataFrame, key: str, column: str, query: list[float], least: float | None = 0.20) -> DataFrame:
    """(key, score) of vectors by cosine to one query vector, which travels as a literal."""
    scored = vectors.select(key, cosine(F.col(column), F.array(*[F.lit(float(x)) for x in query])).alias("score"))
    return scored if least is None else scored.where(F.col("score") >= least)


def related(vectors: DataFrame, key: str, column: str, target) -> DataFrame:
    """(key, score > 0) of the vectors related to the target's own, which is looked up first."""
    row = vectors.where(F.col(key) == target).select(column).first()
    if row is None or row[0] is None:
        return vectors.limit(0).select(key, F.lit(0.0).alias("score"))
    return vector_search(vectors.where(F.col(key) != target), key, column, row[0], None).where("score > 0")


def semantic_query(vectors: DataFrame, key: str, column: str, text: str, least: float | None = 0.20) -> DataFrame:
    """``vector_search`` for a text, embedded as nodes are."""
    return vector_search(vectors, key, column, [float(x) for x in embed(text)], least)


# ---- fusion --------------------------------------------------------------------------------------


def reciprocal_ranks(ranked: list[tuple[DataFrame, float]], key: str, k: int = RRF_K) -> DataFrame:
    """(key, score): sum over lists (key, score) of weight / (k + rank + 1), ranks from 0; ties by key."""
    parts = None
    for df, weight in ranked:
        r = F.row_number().over(Window.orderBy(F.desc("score"), key))  # lists are cut to a few rows before
        part = df.withColumn("part", F.lit(weight) / (k + r)).select(key, "part")
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy(key).agg(F.sum("part").alias("score"))


def kind_factor(query: str) -> Column:
    """Boost of kinds that the query's shape asks for: classes for Camel case, functions for snake case."""
    q, out = query.strip(), F.lit(1.0)
    if q[:1].isupper() and q[:1].isascii() and any(c.islower() for c in q):
        out = F.when(F.col("kind").isin("class", "type"), 1.35).when(F.col("kind") == "trait", 1.20).otherwise(out)
    if "_" in q and any(c.isalpha() for c in q):
        out = F.when(F.col("kind").isin("function", "method"), 1.35).otherwise(out)
    return out


def file_coherence(hits: DataFrame) -> DataFrame:
    """The best hit of each source with two or more gets 0.12 x top score x source's sum / largest sum."""
    by = Window.partitionBy("source_uri")
    alone = F.col("source_uri").isNull()
    h = hits.withColumn("_sum", F.when(~alone, F.sum(F.greatest("score", F.lit(0.0))).over(by))).withColumn("_n", F.count("*").over(by))
    h = h.withColumn("_r", F.row_number().over(by.orderBy(F.desc("score"), "id"))).withColumn("_top", F.max("score").over(Window.partitionBy())).withColumn("_most", F.max("_sum").over(Window.partitionBy()))
    lift = F.when(~alone & (F.col("_n") >= 2) & (F.col("_r") == 1) & (F.col("_most") > 0), F.col("_top") * 0.12 * F.col("_sum") / F.col("_most")).otherwise(0.0)
    return h.withColumn("score", F.col("score") + lift).drop("_sum", "_n", "_r", "_top", "_most")


def hybrid_search(graph: PropertyGraph, query: str, limit: int = 20, index: tuple[DataFrame, DataFrame] | None = None, vectors: DataFrame | None = None, query_vector: list[float] | None = None) -> DataFrame:
    """Names, text index and vectors fused by reciprocal ranks, then boosted by what the query looks like.

    index is ``build_index`` over node ids; vectors has (id, vector). Without either, and without
    identifiers in the query, this is ``ranked_search``. The noise factor applies to name hits twice.
    """
    names = ranked_search(graph, query, 2 * limit)
    identifiers = query_identifiers(query)
    if index is None and vectors is None and not identifiers:
        return ranked_search(graph, query, limit)
    base = names.select("id", "score")
    lists = []
    if index is not None:
        lists.append((bm25(*index, "id", query).orderBy(F.desc("score"), "id").limit(3 * limit), TEXT_WEIGHT))
    if vectors is not None and query_vector is not None:
        lists.append((vector_search(vectors, "id", "vector", query_vector).orderBy(F.desc("score"), "id").limit(3 * limit), VECTOR_WEIGHT))
    if lists:
        base = base.unionByName(reciprocal_ranks(lists, "id"))
    h = base.groupBy("id").agg(F.sum("score").alias("score")).join(graph.nodes.select("id", "qualified_name", "kind", "name", "source_uri"), "id")
    words, path_words = identifier_words(F.col("name")), identifier_words(F.replace("qualified_name", F.lit("::"), F.lit(" ")))
    leaf = identifier_words_text(re.split(r"::|\.", query)[-1])
    symbol = bool(query.strip()) and " " not in query.strip() and ("::" in query or "." in query or "_" in query or any(c.isupper() for c in query))
    tokens = [t for t in identifier_words_text(query).split() if len(t) >= 3 and t not in STOP_WORDS]
    factor = kind_factor(query)
    if "." in query or "::" in query:
        factor = factor * F.when(path_words.contains(identifier_words_text(query.replace("::", " "))), 1.25).otherwise(1.0)
    if identifiers:
        named = F.lit(False)
        for i in identifiers:
            named = named | words.contains(i) | path_words.contains(i)
        factor = factor * F.when(named, 1.30).otherwise(1.0)
    if symbol and leaf:
        hit = (words == leaf) | (compact(words) == leaf.replace(" ", "")) | path_words.contains(leaf)
        factor = factor * F.when(F.col("kind").isin(*DEFINITIONS) & ~is_placeholder(F.col("qualified_name")) & hit, 1.35).otherwise(1.0)
    factor = factor * F.when(is_placeholder(F.col("qualified_name")), 0.45).otherwise(1.0) * noise_factor(F.col("source_uri"), query)
    stem = compact(identifier_words(path_stem(F.col("source_uri"))))
    named_file = F.lit(False)
    for t in tokens:
        named_file = named_file | F.coalesce(stem.contains(t), F.lit(False))
    h = h.withColumn("score", F.col("score") * factor * F.when(named_file, 1.12).otherwise(1.0))
    h = saturated(file_coherence(h.select("id", "qualified_name", "kind", "source_uri", "score")))
    return h.orderBy(F.desc("score"), "qualified_name").limit(limit)


def minimal_context(graph: PropertyGraph, target: str) -> tuple[list, str]:
    """The five best names for a target, and a first guess of the risk: medium above a score of 120."""
    top = ranked_search(graph, target, 5).collect()
    return top, "medium" if top and top[0].score > 120 else "low"


class AmbiguousSymbol(ValueError):
    pass


def resolve_symbol(graph: PropertyGraph, text: str) -> int:
    """Node id of a symbol: its qualified name, else the only sensible name-search hit, else an error with up to five."""
    exact = graph.find(text).select("id").first()
    if exact:
        return exact.id
    hits = ranked_search(graph, text, 50).join(graph.nodes.select("id", "name"), "id").orderBy(F.desc("score"), "qualified_name").collect()
    hits = [h for h in hits if not h.qualified_name.startswith("call::")] or hits
    hits = [h for h in hits if h.kind in ("function", "method", "class", "type", "trait")] or hits
    if len(hits) == 1:
        return hits[0].id
    named = [h for h in hits if h.name == text]
    if len(named) == 1:
        return named[0].id
    raise AmbiguousSymbol(f"{text!r} may be " + ", ".join(h.qualified_name for h in hits[:5]) if hits else f"nothing is called {text!r}")
