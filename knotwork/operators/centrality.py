"""PageRank, also personalised."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.graph import PropertyGraph, is_placeholder
from knotwork.iterate import repeat
from knotwork.session import discard, stage
from knotwork.weights import RANK, edge_weight


#: Links, and nodes, up to which all rounds are one task's work (24 bytes each).
SMALL = 1_000_000


def _settled(base: DataFrame, links: DataFrame, n: int, damping: float, iterations: int) -> DataFrame:
    """(id, rank) by the same rounds in one task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        node = pdf[pdf["dst"].isna()].sort_values("src")
        ids, teleport = node["src"].to_numpy(), node["x"].to_numpy()
        link = pdf[pdf["dst"].notna()]
        ends = [np.searchsorted(ids, link[c].to_numpy(dtype=np.int64)) for c in ("src", "dst")]
        known = np.logical_and(*[(at < n) & (ids[np.minimum(at, n - 1)] == link[c].to_numpy(dtype=np.int64)) for at, c in zip(ends, ("src", "dst"))])
        src, dst, share = ends[0][known], ends[1][known], link["x"].to_numpy()[known]
        rank = np.full(n, 1.0 / n)
        for _ in range(iterations):
            got = np.bincount(dst, rank[src] * share, n)
            rank = teleport * ((1 - damping) + damping * (1.0 - got.sum())) + damping * got
        return pd.DataFrame({"id": ids, "rank": rank})

    rows = base.select(F.col("id").alias("src"), F.lit(None).cast("bigint").alias("dst"), F.col("teleport").alias("x")).unionByName(links.select("src", "dst", F.col("share").alias("x")))
    return rows.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(run, "id bigint, rank double")


def pagerank(graph: PropertyGraph, damping: float = 0.85, iterations: int = 50, seeds: DataFrame | None = None, small: int = SMALL) -> DataFrame:
    """(id, rank): a fixed number of rounds of weighted PageRank; ranks sum to 1.

    An edge weighs its kind's weight times its confidence, 0.05 at least; ambiguous edges are dropped. The mass
    of nodes without edges goes where the teleport goes: everywhere alike, or with seeds (id, weight) to them by
    weight (negative weights count 0; if none is positive, everywhere alike). Contributions combine before
    their shuffle, and only the state of the last round is kept; the links are joined with the ranks anew each round,
    by broadcast as long as the ranks are small and otherwise by a shuffle of both. Up to ``small`` links and nodes
    the same rounds are one task's work.
    """
    e = graph.edges.where("conf_class <> 'ambiguous'").withColumn("w", edge_weight(F.col("kind"), RANK) * F.greatest("confidence", F.lit(0.05)))
    links = e.groupBy("src", "dst").agg(F.sum("w").alias("w"))
    out = links.groupBy("src").agg(F.sum("w").alias("total"))
    links = stage(links.join(out, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("share")), "rank-links")
    n = graph.nodes.select(F.count(F.lit(1)).alias("n")).collect()[0].n  # one number
    if not n:
        return graph.nodes.select("id", F.lit(0.0).alias("rank"))
    base = graph.nodes.select("id", F.lit(1.0 / n).alias("teleport"))
    if seeds is not None:
        s = seeds.groupBy("id").agg(F.sum(F.greatest(F.col("weight"), F.lit(0.0))).alias("weight")).join(graph.nodes.select("id"), "id", "left_semi")
        whole = s.agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("x")).collect()[0].x  # one number
        if whole > 0:
            base = graph.nodes.select("id").join(s, "id", "left").select("id", (F.coalesce("weight", F.lit(0.0)) / whole).alias("teleport"))
    base = stage(base, "rank-base")
    if n <= small and links.count() <= small:
        return _settled(base, links, n, damping, iterations)
    rounds = [None]

    def step(ranks: DataFrame) -> DataFrame:
        got = ranks.join(links, ranks["id"] == links["src"]).groupBy("dst").agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        merged = base.join(got.withColumnRenamed("dst", "id"), "id", "left").select("id", "teleport", F.coalesce("got", F.lit(0.0)).alias("got"))
        # what didn't arrive is dangling mass
        merged = stage(merged, "rank-round")
        discard(rounds[-1])
        rounds.append(merged)
        lost = 1.0 - merged.agg(F.sum("got").alias("s")).collect()[0].s  # one number
        return merged.select("id", (F.col("teleport") * F.lit((1 - damping) + damping * lost) + F.lit(damping) * F.col("got")).alias("rank"))

    return repeat(base.select("id", F.lit(1.0 / n).alias("rank")), step, iterations, "rank", every=iterations + 1)


def without_rank_noise(nodes: DataFrame) -> DataFrame:
    """Nodes worth ranking: no files, flows, hyperedges or call placeholders."""
    return nodes.where(~F.col("kind").isin("file", "flow", "hyperedge") & ~is_placeholder(F.col("qualified_name")))
