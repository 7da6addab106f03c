"""Loops of DataFrame steps whose lineage is cut at a stated cadence."""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.session import discard, stage


def fixpoint(start: DataFrame, step: Callable[[DataFrame], DataFrame], changed: Callable[[DataFrame, DataFrame], DataFrame], label: str) -> DataFrame:
    """Apply ``step`` until ``changed(old, new)`` has no rows, however many rounds that takes.

    Each round is stored, and the one before it removed.

    The step must settle: each caller's values only fall, or its rows only grow.
    """
    current = stage(start, label)
    while True:
        following = stage(step(current), label)
        settled = changed(current, following).isEmpty()
        discard(current)
        if settled:
            return following
        current = following


def repeat(start: DataFrame, step: Callable[[DataFrame], DataFrame], rounds: int, label: str, every: int = 5) -> DataFrame:
    """Apply ``step`` a fixed number of times, storing the state every few rounds."""
    current = start
    for i in range(1, rounds + 1):
        current = step(current)
        if i % every == 0 and i < rounds:
            current = stage(current, label)
    return current


def reach(seeds: DataFrame, links: DataFrame, depth: int | None, label: str = "reach") -> DataFrame:
    """(source, id, depth): breadth-first levels from seeds (source, id) over links (a, b), at most ``depth`` if one is given.

    A node is kept at its first level only. links should be distinct; a hub's links are spread by the
    adaptive skew join. Stops when a level is empty.
    """
    links = stage(links.select("a", "b"), f"{label}-links")
    seen = stage(seeds.select("source", "id", F.lit(0).alias("depth")).distinct(), label)
    levels = [seen]
    frontier = seen
    for d in itertools.count(1) if depth is None else range(1, depth + 1):
        near = frontier.join(links, frontier["id"] == links["a"]).select("source", F.col("b").alias("id")).distinct()
        visited = levels[0]
        for x in levels[1:]:
            visited = visited.unionByName(x)
        fresh = stage(near.join(visited.select("source", "id"), ["source", "id"], "left_anti").withColumn("depth", F.lit(d)), label)
        if fresh.isEmpty():
            break
        levels.append(fresh)
        frontier = fresh
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out
