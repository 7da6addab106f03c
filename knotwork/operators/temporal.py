"""Validity at a commit, and what differs between two commits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def linear_ancestry(commits: DataFrame) -> DataFrame:
    """(ancestor, descendant) of a linear history, itself included; for small histories and tests."""
    a = commits.select(F.col("sha").alias("ancestor"), F.col("ord").alias("x"))
    return a.join(commits.select(F.col("sha").alias("descendant"), F.col("ord").alias("y")), F.col("x") <= F.col("y")).select("ancestor", "descendant")


def active_at(rows: DataFrame, commits: DataFrame, commit: str) -> DataFrame:
    """Rows valid at a commit of a linear history: born at or before it, and not ended before it.

    A null birth means since ever, a null or unknown end never; valid_to is the last commit at which a row
    holds. A birth that isn't in commits is no ancestor, so the row isn't active.
    """
    at = commits.where(F.col("sha") == commit).agg(F.max("ord")).scalar()
    pos = commits.groupBy("sha").agg(F.min("ord").alias("ord"))
    j = rows.join(pos.select(F.col("sha").alias("valid_from"), F.col("ord").alias("_from")), "valid_from", "left").join(pos.select(F.col("sha").alias("valid_to"), F.col("ord").alias("_to")), "valid_to", "left")
    born = F.col("valid_from").isNull() | (F.col("_from") <= at)
    ended = F.col("_to") < at
    return j.where(F.coalesce(born, F.lit(False)) & ~F.coalesce(ended, F.lit(False))).select(*rows.columns)


def temporal_diff(rows: DataFrame, commits: DataFrame, base: str, head: str, key: str) -> DataFrame:
    """(key, change): added at head but not at base, or removed."""
    before = active_at(rows, commits, base).select(key).distinct().withColumn("b", F.lit(True))
    after = active_at(rows, commits, head).select(key).distinct().withColumn("h", F.lit(True))
    j = before.join(after, key, "full")
    return j.where("b is null or h is null").select(key, F.when(F.col("b").isNull(), "added").otherwise("removed").alias("change"))


def changed_nodes(node_diff: DataFrame, edge_diff: DataFrame, edges: DataFrame) -> DataFrame:
    """(id): nodes added or removed, and both ends of added or removed edges."""
    ends = edges.join(edge_diff.select("edge_id"), "edge_id", "left_semi").select(F.explode(F.array("src", "dst")).alias("id"))
    return node_diff.select("id").unionByName(ends).distinct()


def with_archive(active: DataFrame, archive: DataFrame, key: str = "qualified_name") -> DataFrame:
    """Active rows and closed versions as one table; per key the active row wins, then the version closed last."""
    both = active.withColumn("_a", F.lit(1)).unionByName(archive.select(*active.columns).withColumn("_a", F.lit(0)))
    picked = both.groupBy(key).agg(F.max_by(F.struct(*[c for c in both.columns if c != key]), F.struct("_a", "valid_to")).alias("r"))
    return picked.select(*[F.col(key) if c == key else F.col(f"r.{c}").alias(c) for c in active.columns])
