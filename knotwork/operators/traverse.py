"""Neighbourhoods, bounded paths, reverse impact and what-if reachability."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knotwork.graph import PropertyGraph
from knotwork.iterate import reach
from knotwork.session import stage
from knotwork.weights import BOOST, IMPACT, PATH, edge_weight, node_weight


def links(graph: PropertyGraph, direction: str = "out") -> DataFrame:
    """Distinct (a, b) along, against or both ways of the edges."""
    e = graph.edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    if direction == "in":
        e = e.select(F.col("b").alias("a"), F.col("a").alias("b"))
    elif direction == "both":
        e = e.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p")).select("p.*")
    elif direction != "out":
        raise ValueError(f"direction is in, out or both, not {direction!r}")
    return e.distinct()


def callers_of(graph: PropertyGraph, targets: DataFrame) -> DataFrame:
    """(target, caller) over calls edges, multi-edges kept; targets has id."""
    calls = graph.edges.where("kind = 'calls'")
    return calls.join(targets.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("dst").alias("target"), F.col("src").alias("caller"))


def callees_of(graph: PropertyGraph, sources: DataFrame) -> DataFrame:
    calls = graph.edges.where("kind = 'calls'")
    return calls.join(sources.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("src").alias("source"), F.col("dst").alias("callee"))


def bounded_reach(graph: PropertyGraph, seeds: DataFrame, depth: int = 3, direction: str = "both") -> DataFrame:
    """(source, id, depth) of everything within ``depth`` steps of each seed (id)."""
    return reach(seeds.select(F.col("id").alias("source"), "id"), links(graph, direction), depth)


def traverse(graph: PropertyGraph, seeds: DataFrame, direction: str = "both", depth: int = 3, token_budget: int = 1200) -> DataFrame:
    """Nodes by level and name until the budget is used; a node costs a quarter of its JSON's characters.

    A node is given while the tokens before it stay below the budget, so the last may overrun it.
    """
    found = bounded_reach(graph, seeds, depth, direction).join(graph.nodes, "id")
    card = F.to_json(F.struct("qualified_name", "kind", "source_uri", "depth"))
    cost = F.ceil(F.length(card) / 4).cast("bigint")
    order = Window.partitionBy("source").orderBy("depth", "qualified_name")
    priced = found.withColumn("tokens", cost).withColumn("used", F.sum("tokens").over(order))
    return priced.where(F.col("used") - F.col("tokens") < token_budget).select("source", "id", "qualified_name", "kind", "depth", "tokens")


def simple_paths(graph: PropertyGraph, starts: DataFrame, targets: DataFrame, max_hops: int = 5, kinds: list[str] | None = None, min_confidence: float = 0.0, stop_at_target: bool = False) -> DataFrame:
    """(path, cost, hops): every simple directed path from a start (id) to a target (id).

    cost sums the kind's base cost over the confidence clamped to 0.05..1; of parallel edges the cheapest
    counts. With ``stop_at_target`` paths end at their first target, as the cheapest-path search needs.
    """
    e = graph.edges.where(F.col("confidence") >= min_confidence)
    if kinds:
        e = e.where(F.col("kind").isin(kinds))
    step = edge_weight(F.col("kind"), PATH) / F.least(F.greatest("confidence", F.lit(0.05)), F.lit(1.0))
    e = stage(e.where("src <> dst").groupBy("src", "dst").agg(F.min(step).alias("step")), "path-links")
    goal = targets.select(F.col("id").alias("tail"), F.lit(True).alias("goal")).distinct()
    front = starts.select(F.array("id").alias("path"), F.col("id").alias("tail"), F.lit(0.0).alias("cost"))
    done = None
    for hop in range(1, max_hops + 1):
        grown = front.join(e, front["tail"] == e["src"]).where(~F.array_contains("path", F.col("dst")))
        grown = grown.select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("tail"), (F.col("cost") + F.col("step")).alias("cost"))
        front = stage(grown.join(goal, "tail", "left").withColumn("hops", F.lit(hop)), "paths")
        hits = front.where("goal").select("path", "cost", "hops")
        done = hits if done is None else done.unionByName(hits)
        if stop_at_target:
            front = front.where("goal is null")
        front = front.select("path", "tail", "cost")
    return done


def top_paths(graph: PropertyGraph, starts: DataFrame, targets: DataFrame, max_hops: int = 5, limit: int = 10, **options) -> DataFrame:
    """(rank, path, cost, hops): the ``limit`` cheapest simple paths; ties prefer fewer hops, then smaller ids."""
    found = simple_paths(graph, starts, targets, max_hops, stop_at_target=True, **options)
    best = found.orderBy("cost", "hops", "path").limit(limit)
    return best.withColumn("rank", F.row_number().over(Window.orderBy("cost", "hops", "path")))  # at most ``limit`` rows


def diversify(paths: list[tuple[list[int], float]], penalty: float = 0.15) -> list[tuple[list[int], float]]:
    """Greedy order of few paths: each pick adds ``penalty`` times the shared share to the costs of the rest."""
    rest, out = [(list(p), c) for p, c in paths], []
    while rest:
        rest.sort(key=lambda x: (x[1], len(x[0]), x[0]))
        chosen = rest.pop(0)
        out.append(chosen)
        have = set(chosen[0])
        rest = [(p, c + penalty * len(have & set(p)) / max(1, min(len(p), len(chosen[0])))) for p, c in rest]
    return out


def impact(graph: PropertyGraph, seeds: DataFrame, max_hops: int = 4) -> DataFrame:
    """(source, id, score, cost, distance): what depends on each seed, by reverse edges.

    The least cost over paths of at most ``max_hops`` edges against the edges' direction, by relaxing
    one hop a round; score is the kind's boost over 1 + cost. Of equal costs the shorter distance counts.
    """
    step = edge_weight(F.col("kind"), IMPACT) / F.least(F.greatest("confidence", F.lit(0.05)), F.lit(1.0))
    back = stage(graph.edges.where("src <> dst").groupBy(F.col("dst").alias("a"), F.col("src").alias("b")).agg(F.min(step).alias("step")), "impact-links")
    # best cost with exactly <= h hops: relax from the previous round's improved entries only
    best = stage(seeds.select(F.col("id").alias("source"), "id", F.lit(0.0).alias("cost"), F.lit(0).alias("distance")), "impact")
    front = best
    for hop in range(1, max_hops + 1):
        near = front.join(back, front["id"] == back["a"]).groupBy("source", F.col("b").alias("id")).agg(F.min(F.col("cost") + F.col("step")).alias("near"))
        front = stage(near.join(best, ["source", "id"], "left").where("cost is null or near < cost").select("source", "id", F.col("near").alias("cost"), F.lit(hop).alias("distance")), "impact")
        both = best.unionByName(front)
        best = stage(both.groupBy("source", "id").agg(F.min(F.struct("cost", "distance")).alias("r")).select("source", "id", "r.cost", "r.distance"), "impact")
    score = node_weight(F.col("kind"), BOOST) / (1 + F.col("cost"))
    return best.where("distance > 0").join(graph.nodes.select("id", "kind"), "id").select("source", "id", score.alias("score"), "cost", "distance")


def counterfactual(graph: PropertyGraph, target: DataFrame, direction: str = "out", depth: int = 5) -> DataFrame:
    """(id, depth): what the target (id) no longer reaches once its edges in ``direction`` are dropped.

    Reach runs along the edges for ``out`` and ``both`` and against them for ``in``.
    """
    way = "in" if direction == "in" else "out"
    t = target.select("id")
    dropped = {"out": ["src"], "in": ["dst"], "both": ["src", "dst"]}[direction]
    edges = graph.edges
    for end in dropped:
        edges = edges.join(t.withColumnRenamed("id", end), end, "left_anti")
    before = bounded_reach(graph, t, depth, way)
    after = bounded_reach(PropertyGraph(graph.nodes, edges), t, depth, way)
    return before.join(after.select("id"), "id", "left_anti").select("id", "depth")


