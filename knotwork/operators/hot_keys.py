"""Per-key counts where a few keys hold most rows: two-stage salted aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _sides(edges: DataFrame, sides: Sequence[tuple[str, str]], row_id: str, kind: str) -> DataFrame:
    """One row per non-null key of each side: (side, key, kind, row_id)."""
    pairs = F.array(*[F.struct(F.lit(s).alias("side"), F.col(c).cast("bigint").alias("key")) for s, c in sides])
    return (
        edges.select(F.col(row_id).alias("row_id"), F.col(kind).alias("kind"), F.explode(pairs).alias("p"))
        .select("p.side", "p.key", "kind", "row_id")
        .where(F.col("key").isNotNull())
    )


def heavy_keys(keys: DataFrame, fraction: float) -> DataFrame:
    """(side, key) of the keys holding at least ``fraction`` of their side's rows.

    Every side has at most 1/fraction such keys, whatever the input's size, so the result may be
    broadcast. The counts combine before the shuffle: each task sends one row per key.
    """
    counts = keys.groupBy("side", "key").agg(F.count("*").alias("n"))
    totals = keys.groupBy("side").agg((F.count("*") * F.lit(fraction)).alias("least"))
    return counts.join(F.broadcast(totals), "side").where("n >= least").select("side", "key")


def salted_counts(
    edges: DataFrame,
    sides: Sequence[tuple[str, str]] = (("src", "src_id"), ("dst", "dst_id")),
    row_id: str = "edge_id",
    kind: str = "kind",
    salts: int = 64,
    heavy_fraction: float = 0.005,
) -> DataFrame:
    """(side, node_id, kind, n_rows, n_edges) for each key of each side.

    n_rows counts rows, repeated ones included; n_edges counts distinct non-null ``row_id``. Keys with
    at least ``heavy_fraction`` of a side's rows get a salt, so no task holds more than about
    heavy_fraction + 1/salts of a side. The salt is a hash of the row id rather than a random draw:
    as even as one, the same when a lost task is run again, and equal ids share a salt, so distinct
    counts of the salts add up. Stage one deduplicates and counts per (key, salt) behind the only
    shuffle of rows; stage two merges at most ``salts`` partial rows per key and kind.

    A null key is no key and gives no row; a null kind is a kind of its own; a null row id counts as a
    row but not as an edge (all null ids of a key share a salt). An empty table gives an empty result;
    other columns are ignored.
    """
    keys = _sides(edges, sides, row_id, kind)
    heavy = heavy_keys(keys, heavy_fraction).withColumn("heavy", F.lit(True))
    salted = keys.join(F.broadcast(heavy), ["side", "key"], "left").select(
        "side", "key", "kind", "row_id",
        F.when(F.col("heavy"), F.pmod(F.xxhash64("row_id"), F.lit(salts))).otherwise(F.lit(0)).cast("int").alias("salt"),
    )
    # groupings below refine (side, key, salt), so they need no exchange of their own
    spread = salted.repartition("side", "key", "salt")
    distinct = spread.groupBy("side", "key", "salt", "kind", "row_id").agg(F.count("*").alias("n"))
    partial = distinct.groupBy("side", "key", "salt", "kind").agg(
        F.sum("n").alias("n_rows"), F.count("row_id").alias("n_edges")
    )
    return (
        partial.groupBy("side", "key", "kind")
        .agg(F.sum("n_rows").alias("n_rows"), F.sum("n_edges").alias("n_edges"))
        .select("side", F.col("key").alias("node_id"), "kind", "n_rows", "n_edges")
    )


def dominant_keys(edges: DataFrame, share: float = 0.01, **options) -> DataFrame:
    """(side, node_id) of the keys that hold at least ``share`` of all rows of ``edges``.

    Taken from ``salted_counts``; rows with a null key count towards all rows.
    """
    total = edges.select(F.count(F.lit(1)).alias("n")).scalar()
    return (
        salted_counts(edges, **options)
        .groupBy("side", "node_id")
        .agg(F.sum("n_rows").alias("n"))
        .where(F.col("n") >= total * F.lit(share))
        .select("side", "node_id")
    )
