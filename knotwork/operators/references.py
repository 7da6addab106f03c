"""References to records that are missing, deleted or arrive later than the reference."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _ordinal(df: DataFrame, column: str, commits: DataFrame, name: str) -> DataFrame:
    """Adds ``name``, the position of the commit in ``column``; null if null or unknown."""
    known = commits.groupBy(F.col("sha").alias("_sha")).agg(F.min("ord").alias(name))
    return df.join(known, df[column] == F.col("_sha"), "left").drop("_sha")


def parent_intervals(nodes: DataFrame, commits: DataFrame) -> DataFrame:
    """(key, born, gone) per node id: the latest birth and the latest end of its rows, as positions.

    A null valid_from means since ever (-1), and so does one that isn't in commits; a null or unknown
    valid_to means never gone.
    """
    rows = nodes.select(F.col("id").alias("key"), "valid_from", "valid_to").where("key is not null")
    rows = _ordinal(_ordinal(rows, "valid_from", commits, "_from"), "valid_to", commits, "_to")
    return rows.groupBy("key").agg(
        F.max(F.coalesce("_from", F.lit(-1))).alias("born"),
        F.when(F.count("_to") == F.count("*"), F.max("_to")).alias("gone"),
    )


def classify_references(
    edges: DataFrame,
    nodes: DataFrame,
    commits: DataFrame,
    sides: Sequence[tuple[str, str]] = (("src", "src_id"), ("dst", "dst_id")),
    salts: int = 64,
    heavy_fraction: float = 0.005,
) -> DataFrame:
    """(edge_id, side, key, ingested_at, status) of every reference that doesn't hold.

    status is ``missing`` (no parent row), ``late`` (the parent begins at a later commit than the
    reference) or ``deleted`` (the parent ended before the reference began). References and parents are
    hash-partitioned and sorted on (key, salt) and merged by a sort-merge join; the parent's validity
    interval then separates the cases. Keys with at least ``heavy_fraction`` of the references, of which
    there are at most 1/heavy_fraction a side, are salted by a hash of the edge id, and only their parent
    rows are repeated once per salt. One output row per input row and side: repeated rows stay repeated.

    A null key is no reference. A reference with a null or unknown valid_from is tested for absence only.
    An empty nodes table makes every reference missing.
    """
    pairs = F.array(*[F.struct(F.lit(s).alias("side"), F.col(c).cast("bigint").alias("key")) for s, c in sides])
    refs = _ordinal(edges.select("edge_id", "src_id", "dst_id", "valid_from", "ingested_at"), "valid_from", commits, "at")
    refs = refs.select("edge_id", "ingested_at", "at", F.explode(pairs).alias("p")).select(
        "edge_id", "ingested_at", "at", "p.side", "p.key").where("key is not null")
    counted = edges.select(F.explode(pairs).alias("p")).select("p.side", "p.key").where("key is not null")
    n = counted.groupBy("key").agg(F.count("*").alias("n"))
    least = n.agg((F.sum("n") * F.lit(heavy_fraction)).alias("x")).scalar()
    heavy = n.where(F.col("n") >= least).select("key", F.lit(True).alias("heavy"))
    refs = refs.join(F.broadcast(heavy), "key", "left").withColumn(
        "salt", F.when(F.col("heavy"), F.pmod(F.xxhash64("edge_id"), F.lit(salts)).cast("int")).otherwise(0)).drop("heavy")
    parents = parent_intervals(nodes, commits).join(F.broadcast(heavy), "key", "left").withColumn(
        "salt", F.explode(F.when(F.col("heavy"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("heavy")
    joined = refs.join(parents.withColumn("found", F.lit(True)).hint("merge"), ["key", "salt"], "left")
    status = (
        F.when(F.col("found").isNull(), "missing")
        .when(F.col("born") > F.col("at"), "late")
        .when(F.col("gone") < F.col("at"), "deleted")
    )
    return joined.select("edge_id", "side", "key", "ingested_at", status.alias("status")).where("status is not null")


def orphan_references(edges: DataFrame, nodes: DataFrame, commits: DataFrame, **options) -> DataFrame:
    """Distinct (edge_id, side) whose parent is missing or younger; ends of parents play no part."""
    bad = classify_references(edges, nodes, commits, **options)
    return bad.where(F.col("status").isin("missing", "late")).select("edge_id", "side").distinct()


def orphan_report(edges: DataFrame, nodes: DataFrame, commits: DataFrame, **options) -> DataFrame:
    """(side, month, status, n_rows, n_edges): missing and late references per month of ingestion.

    month is the first day of the month of ingested_at, null where that is null. n_rows counts rows,
    n_edges distinct edge ids.
    """
    bad = classify_references(edges, nodes, commits, **options).where(F.col("status").isin("missing", "late"))
    return (
        bad.groupBy("side", F.trunc("ingested_at", "month").alias("month"), "status")
        .agg(F.count("*").alias("n_rows"), F.countDistinct("edge_id").alias("n_edges"))
    )
