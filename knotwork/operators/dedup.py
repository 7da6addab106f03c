"""Merging of nodes whose labels are nearly the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.functions.similarity import jaro_winkler_column, nfc
from knotwork.graph import PropertyGraph
from knotwork.operators.structure import least_labels
from knotwork.session import stage

KINDS = ("concept", "document", "section", "diagram", "image", "hyperedge")
BANDS, ROWS, HASHES = 12, 5, 64


def normalised_label(label: Column) -> Column:
    """NFC, lower case, no trailing version or digits, other characters as single underscores; else the label."""
    out = F.regexp_replace(F.lower(nfc(label)), r"\b[vV]?[ _]?\d+\.?\d*$", "")
    out = F.regexp_replace(out, r"([a-zA-Z_])[ _]?\d+$", "$1")
    out = F.regexp_replace(F.regexp_replace(out, "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(out == "", label).otherwise(out)


def entropy(text: Column) -> Column:
    """Bits per character."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(chars)
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda s, c: s - share(c) * F.log2(share(c)))


def passes_entropy_gate(text: Column, least: float = 0.5) -> Column:
    """Under three characters: yes; up to five with three or fewer different ones: no; else by entropy."""
    different = F.size(F.array_distinct(F.filter(F.split(text, ""), lambda c: c != "")))
    return F.when(F.length(text) < 3, True).when((F.length(text) <= 5) & (different <= 3), False).otherwise(entropy(text) >= least)


def shingles(label: Column, n: int = 3) -> Column:
    """Distinct n-grams of a label, a shorter label as a whole."""
    grams = F.transform(F.sequence(F.lit(1), F.length(label) - n + 1), lambda i: F.substring(label, i, n))
    return F.when(F.length(label) < n, F.array(label)).otherwise(F.array_distinct(grams))


def minhash(grams: Column, hashes: int = HASHES) -> Column:
    """``hashes`` minima of seeded 64-bit hashes."""
    return F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda s: F.array_min(F.transform(grams, lambda g: F.xxhash64(s, g))))


def candidate_pairs(labels: DataFrame, least: float = 0.7) -> DataFrame:
    """(a, b, estimate) of labels (id, label) that share a band of their MinHash and look similar enough.

    Equal labels are one entry of the index: they are linked to their least id, not to one another.
    """
    entry = labels.groupBy("label").agg(F.min("id").alias("id"))
    signed = stage(entry.select("id", minhash(shingles(F.col("label"))).alias("m")), "label-hashes")
    band = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.slice("m", i * ROWS + 1, ROWS)))
    posted = signed.select("id", F.explode(band).alias("band"))
    pairs = posted.withColumnRenamed("id", "a").join(posted.withColumnRenamed("id", "b"), "band").where("a < b").select("a", "b").distinct()
    m = lambda k: signed.select(F.col("id").alias(k), F.col("m").alias(f"m{k}"))
    same = F.aggregate(F.zip_with("ma", "mb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / HASHES
    near = pairs.join(m("a"), "a").join(m("b"), "b").withColumn("estimate", same).where(F.col("estimate") >= least).select("a", "b", "estimate")
    copies = labels.join(entry.withColumnRenamed("id", "a"), "label").where("id <> a").select("a", F.col("id").alias("b"), F.lit(1.0).alias("estimate"))
    return near.unionByName(copies)


def duplicate_pairs(graph: PropertyGraph, communities: DataFrame | None = None, threshold: float = 0.92, boost: float = 0.05) -> DataFrame:
    """(a, b, score) of eligible nodes whose normalised names are similar by Jaro-Winkler; +boost in one community."""
    n = graph.nodes.where(F.col("kind").isin(*KINDS) & F.col("name").isNotNull()).select("id", "name", normalised_label(F.col("name")).alias("norm"))
    n = stage(n.where(passes_entropy_gate(F.col("norm"))), "labels")
    pairs = candidate_pairs(n.select("id", F.col("name").alias("label")))
    side = lambda k: n.select(F.col("id").alias(k), F.col("norm").alias(f"n{k}"))
    j = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("score", jaro_winkler_column(F.col("na"), F.col("nb")))
    if communities is not None:
        c = communities.select("id", "community")
        j = j.join(c.select(F.col("id").alias("a"), F.col("community").alias("ca")), "a", "left").join(c.select(F.col("id").alias("b"), F.col("community").alias("cb")), "b", "left")
        j = j.withColumn("score", F.least(F.lit(1.0), F.col("score") + F.when(F.col("ca") == F.col("cb"), boost).otherwise(0.0)))
    return j.where(F.col("score") >= threshold).select("a", "b", "score")


def merge_map(graph: PropertyGraph, pairs: DataFrame) -> DataFrame:
    """(loser, winner): every duplicate to the least id of its component."""
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return least_labels(graph.nodes, both).where("id <> component").select(F.col("id").alias("loser"), F.col("component").alias("winner"))


def deduplicate(graph: PropertyGraph, communities: DataFrame | None = None, threshold: float = 0.92, boost: float = 0.05) -> tuple[PropertyGraph, DataFrame]:
    """(graph, mapping): duplicates merged, edges rewired without loops or repeats."""
    mapping = stage(merge_map(graph, duplicate_pairs(graph, communities, threshold, boost)), "merges")
    return graph.merge_nodes(mapping), mapping
