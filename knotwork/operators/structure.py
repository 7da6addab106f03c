"""Components, cycles, cores, cut points, betweenness, hubs and bridges."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knotwork.graph import PropertyGraph, is_placeholder
from knotwork.iterate import fixpoint, reach
from knotwork.operators.traverse import links
from knotwork.session import discard, stage


def hub_nodes(graph: PropertyGraph, top: int = 25) -> DataFrame:
    """The nodes of highest degree, without files: (id, qualified_name, kind, in_degree, out_degree, degree)."""
    named = graph.nodes.where("kind <> 'file'").select("id", "qualified_name", "kind")
    return graph.degrees().where("degree > 0").join(named, "id").orderBy(F.desc("degree"), "qualified_name").limit(top)


def call_resolution(graph: PropertyGraph) -> DataFrame:
    """(resolved, unresolved, rate) of calls edges; a call of a placeholder is unresolved; rate is 1 without calls."""
    target = graph.nodes.select(F.col("id").alias("dst"), is_placeholder(F.col("qualified_name")).alias("open"))
    c = graph.edges.where("kind = 'calls'").join(target, "dst").agg(
        F.coalesce(F.sum((~F.col("open")).cast("bigint")), F.lit(0)).alias("resolved"), F.coalesce(F.sum(F.col("open").cast("bigint")), F.lit(0)).alias("unresolved"))
    total = F.col("resolved") + F.col("unresolved")
    return c.withColumn("rate", F.when(total == 0, 1.0).otherwise(F.col("resolved") / F.when(total > 0, total)))


def least_labels(ids: DataFrame, pairs: DataFrame, label: str = "components") -> DataFrame:
    """(id, component): the least id of each connected component of symmetric pairs (a, b).

    Large-star and small-star rounds in turn: stars shrink components in about log(n) rounds, whatever their
    diameter, and no round gathers a component in one task. They end when nothing changes.
    """
    edges = stage(pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = stage(large, label)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = joined.select("a", F.col("m").alias("b")).unionByName(joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        small = stage(small, label)
        discard(large)
        settled = small.exceptAll(edges).isEmpty() and edges.exceptAll(small).isEmpty()
        discard(edges)
        edges = small
        if settled:
            break
    return ids.select("id").join(edges.select(F.col("a").alias("id"), F.col("b").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def components(graph: PropertyGraph) -> DataFrame:
    """(id, component) ignoring directions; component is the least id in it."""
    return least_labels(graph.nodes, graph.undirected())


#: Links up to which the rest of a strong-components search is one task's work (16 bytes each).
SMALL_LINKS = 100_000


def _strong(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, least id of the strong component) of a directed graph: Tarjan's algorithm, iteratively."""
    ids, inverse = np.unique(np.concatenate((a, b)), return_inverse=True)
    head, tail = inverse[: len(a)], inverse[len(a) :]
    order = np.argsort(head, kind="stable")
    tail = tail[order].tolist()
    at = np.searchsorted(head[order], np.arange(len(ids) + 1)).tolist()
    stop = at[1:]
    n, clock = len(ids), 0
    seen, low, on, label, open_ = [0] * n, [0] * n, [False] * n, [0] * n, []
    for root in range(n):
        if seen[root]:
            continue
        stack = [root]
        while stack:
            v = stack[-1]
            if not seen[v]:
                clock += 1
                seen[v] = low[v] = clock
                on[v] = True
                open_.append(v)
            if at[v] < stop[v]:
                w = tail[at[v]]
                at[v] += 1
                if not seen[w]:
                    stack.append(w)
                elif on[w]:
                    low[v] = min(low[v], seen[w])
                continue
            stack.pop()
            if stack:
                low[stack[-1]] = min(low[stack[-1]], low[v])
            if low[v] == seen[v]:
                member = []
                while True:
                    w = open_.pop()
                    on[w] = False
                    member.append(w)
                    if w == v:
                        break
                for w in member:
                    label[w] = min(member)  # positions are in the ids' order
    return ids, ids[np.array(label, dtype=np.int64)] if n else ids


def strong_components(graph: PropertyGraph, small: int = SMALL_LINKS) -> DataFrame:
    """(id, component): strongly connected components, named by their least id.

    Trimming drops nodes without in- or out-edges, which are components of their own. In each round the nodes
    left take the least id that reaches them (forward colouring); those of a colour that reach its root
    backwards are its component. They go, and the rest is coloured anew, along the reversed links every other
    round: a chain of components in the ids' order, of which one direction frees only the first, falls apart in
    the other. Once at most ``small`` links are left, one task finishes them. Nothing ends before it has settled.
    """

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, label = _strong(pdf["a"].to_numpy(), pdf["b"].to_numpy())
        return pd.DataFrame({"id": ids, "component": label}, dtype="int64")

    left = stage(links(graph).where("a <> b"), "scc")
    done = None
    while True:
        for _ in range(3):
            trimmed = left.join(left.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(left.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b")
            left = stage(trimmed, "scc")
        n = left.count()
        if n <= small:
            if n:
                rest = left.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(finish, "id bigint, component bigint")
                done = rest if done is None else done.unionByName(rest)
            break
        nodes = left.select(F.explode(F.array("a", "b")).alias("id")).distinct()

        def spread(c: DataFrame, left: DataFrame = left) -> DataFrame:
            got = left.join(c, left["a"] == c["id"]).select(F.col("b").alias("id"), "colour")
            return c.unionByName(got).groupBy("id").agg(F.min("colour").alias("colour"))

        colours = fixpoint(nodes.select("id", F.col("id").alias("colour")), spread, lambda a, b: b.exceptAll(a), "scc-colour")
        inner = left.join(colours.select(F.col("id").alias("a"), F.col("colour").alias("ca")), "a").join(colours.select(F.col("id").alias("b"), F.col("colour").alias("cb")), "b").where("ca = cb").select(F.col("b").alias("a"), F.col("a").alias("b"))
        inner = stage(inner, "scc-inner")

        def back(c: DataFrame, inner: DataFrame = inner) -> DataFrame:
            return c.unionByName(inner.join(c, inner["a"] == c["id"]).select(F.col("b").alias("id"), "component")).distinct()

        roots = colours.where("id = colour").select("id", F.col("id").alias("component"))
        found = fixpoint(roots, back, lambda a, b: b.exceptAll(a), "scc-back")
        done = found if done is None else done.unionByName(found)
        gone = found.select("id")
        left = stage(left.join(gone.withColumnRenamed("id", "a"), "a", "left_anti").join(gone.withColumnRenamed("id", "b"), "b", "left_anti").select(F.col("b").alias("a"), F.col("a").alias("b")), "scc")
    ids = graph.nodes.select("id")
    if done is None:
        return ids.select("id", F.col("id").alias("component"))
    return ids.join(done, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def cycles(graph: PropertyGraph) -> DataFrame:
    """(component, size): strong components of more than one node, or one with a loop."""
    scc = strong_components(graph)
    loops = graph.edges.where("src = dst").select(F.col("src").alias("component")).distinct()
    sizes = scc.groupBy("component").agg(F.count("*").alias("size"))
    alone = sizes.where("size = 1").join(loops, "component", "left_semi")
    return sizes.where("size > 1").unionByName(alone)


def _cores(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, core number) of a simple graph given as symmetric pairs: nodes of the least degree left go first."""
    ids, inverse = np.unique(np.concatenate((a, b)), return_inverse=True)
    head, tail = inverse[: len(a)], inverse[len(a) :]
    order = np.argsort(head, kind="stable")
    tail = tail[order].tolist()
    start = np.searchsorted(head[order], np.arange(len(ids) + 1)).tolist()
    degree = np.diff(start).tolist()
    core, waiting = [-1] * len(ids), [[] for _ in range(max(degree, default=0) + 1)]
    for v, d in enumerate(degree):
        waiting[d].append(v)
    for k, bucket in enumerate(waiting):
        while bucket:
            v = bucket.pop()
            if core[v] >= 0:
                continue
            core[v] = k
            for w in tail[start[v] : start[v + 1]]:
                if core[w] < 0 and degree[w] > k:
                    degree[w] -= 1
                    waiting[degree[w]].append(w)
    return ids, np.array(core, dtype=np.int64)


#: Pairs up to which one task peels the whole graph: its lists take about 100 bytes a pair.
CORE_LINKS = 1_000_000


def core_numbers(graph: PropertyGraph, small: int = CORE_LINKS) -> DataFrame:
    """(id, core) of the undirected simple graph: repeated h-index of the neighbours' values.

    Starting from the degrees, each node takes the largest h such that h neighbours have at least h; this
    falls to the core number everywhere, and the rounds go on until no value falls. The h-index comes from
    counts per value, so a hub's neighbours are never gathered in a list. At most ``small`` pairs are one
    task's peeling instead, as a long path takes half as many rounds as it has nodes.
    """
    pairs = stage(graph.undirected(), "core-links")

    def peel(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, core = _cores(pdf["a"].to_numpy(), pdf["b"].to_numpy())
        return pd.DataFrame({"id": ids, "core": core}, dtype="int64")

    if pairs.count() <= small:
        settled = pairs.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(peel, "id bigint, core bigint")
        return graph.nodes.select("id").join(settled, "id", "left").select("id", F.coalesce("core", F.lit(0)).cast("bigint").alias("core"))
    degree = pairs.groupBy("a").agg(F.count("*").alias("core")).withColumnRenamed("a", "id")

    def step(c: DataFrame) -> DataFrame:
        mine = c.select(F.col("id").alias("a"), F.col("core").alias("mine"))
        theirs = c.select(F.col("id").alias("b"), F.col("core").alias("theirs"))
        tally = pairs.join(theirs, "b").join(mine, "a").groupBy("a", "mine", F.least("mine", "theirs").alias("v")).agg(F.count("*").alias("k"))
        at_least = tally.withColumn("cum", F.sum("k").over(Window.partitionBy("a").orderBy(F.desc("v"))))
        # between two values v the count of neighbours at or above stays, so h is the best of min(v, cum)
        return at_least.groupBy("a").agg(F.max(F.least("v", "cum")).alias("core")).withColumnRenamed("a", "id")

    settled = fixpoint(degree, step, lambda a, b: b.exceptAll(a), "core")
    return graph.nodes.select("id").join(settled, "id", "left").select("id", F.coalesce("core", F.lit(0)).cast("bigint").alias("core"))


def _cut_points(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cut vertices of a connected simple graph given as symmetric pairs: Tarjan's low points, iteratively."""
    ids, inverse = np.unique(np.concatenate((a, b)), return_inverse=True)
    head, tail = inverse[: len(a)], inverse[len(a) :]
    order = np.argsort(head, kind="stable")
    tail = tail[order].tolist()
    start = np.searchsorted(head[order], np.arange(len(ids) + 1)).tolist()
    n = len(ids)
    seen, low, parent, cut = [0] * n, [0] * n, [-1] * n, [False] * n
    clock = 0
    for root in range(n):
        if seen[root]:
            continue
        clock += 1
        seen[root] = low[root] = clock
        children, stack, at = 0, [root], start[:]
        while stack:
            v = stack[-1]
            if at[v] < start[v + 1]:
                w = tail[at[v]]
                at[v] += 1
                if not seen[w]:
                    parent[w] = v
                    children += v == root
                    clock += 1
                    seen[w] = low[w] = clock
                    stack.append(w)
                elif w != parent[v]:
                    low[v] = min(low[v], seen[w])
            else:
                stack.pop()
                p = parent[v]
                if p >= 0:
                    low[p] = min(low[p], low[v])
                    if p != root and low[v] >= seen[p]:
                        cut[p] = True
        cut[root] = children > 1
    return ids[np.array(cut, dtype=bool)]


def _cut_points_at_any_size(pairs: DataFrame, member: DataFrame) -> DataFrame:
    """(id) of the cut points of symmetric pairs (a, b) with member (a, component), by levels of a spanning tree.

    The tree edges, each named by its child, fall into the blocks of the graph: a link between unrelated nodes
    joins their edges, and a node's edge joins its parent's if its subtree has a link that leaves the parent's.
    Preorder numbers and subtree sizes tell who is related, their least and greatest linked numbers who leaves.
    A node is a cut point if its edge and its children's are in more than one block. Rounds: the tree's depth.
    """
    roots = member.where("a = component").select(F.col("a").alias("source"), F.col("a").alias("id"))
    level = stage(reach(roots, pairs, None, "cut-levels").select("id", "source", "depth"), "cut-levels")
    up = pairs.join(level.select(F.col("id").alias("a"), F.col("depth").alias("da")), "a").join(level.select(F.col("id").alias("b"), F.col("depth").alias("db")), "b")
    parent = up.where("da + 1 = db").groupBy(F.col("b").alias("id")).agg(F.min("a").alias("parent"))
    tree = stage(level.join(parent, "id", "left"), "cut-tree")
    deepest = tree.agg(F.max("depth").alias("d")).collect()[0].d or 0  # one number
    at = lambda df, d: df.where(F.col("depth") == d)

    def upwards(own: DataFrame, how: dict) -> DataFrame:
        """Own values (id, parent, depth, columns) combined with those of all descendants."""
        done, below = None, None
        for d in range(deepest, -1, -1):
            here = at(own, d)
            if below is not None:
                sums = below.groupBy(F.col("parent").alias("id")).agg(*[f(c).alias(f"_{c}") for c, (f, _) in how.items()])
                here = here.join(sums, "id", "left")
                for c, (_, both) in how.items():
                    here = here.withColumn(c, F.when(F.col(f"_{c}").isNull(), F.col(c)).otherwise(both(F.col(c), F.col(f"_{c}"))))
                here = here.select(*own.columns)
            below = stage(here, "cut-up")
            done = below if done is None else done.unionByName(below)
        return done

    sized = stage(upwards(tree.withColumn("nd", F.lit(1).cast("bigint")), {"nd": (F.sum, lambda x, y: x + y)}), "cut-sizes")
    before = F.sum("nd").over(Window.partitionBy("parent").orderBy("id")) - F.col("nd")
    placed = stage(sized.withColumn("shift", F.when(F.col("parent").isNull(), F.lit(0)).otherwise(before + 1)), "cut-shifts")
    above = stage(at(placed, 0).select("id", F.lit(0).cast("bigint").alias("pre")), "cut-pre")
    pre = above
    for d in range(1, deepest + 1):
        above = stage(at(placed, d).join(above.select(F.col("id").alias("parent"), F.col("pre").alias("p")), "parent").select("id", (F.col("p") + F.col("shift")).alias("pre")), "cut-pre")
        pre = pre.unionByName(above)
    t = stage(sized.join(pre, "id"), "cut-numbered")
    side = lambda k: t.select(F.col("id").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in ("pre", "nd", "parent")])
    other = stage(pairs.join(side("a"), "a").join(side("b"), "b").where("not (parent_a <=> b) and not (parent_b <=> a)"), "cut-others")
    ends = other.groupBy(F.col("a").alias("id")).agg(F.min("pre_b").alias("l"), F.max("pre_b").alias("h"))
    own = t.join(ends, "id", "left").select("id", "parent", "depth", F.least("pre", "l").alias("low"), F.greatest("pre", "h").alias("high"))
    spans = upwards(own, {"low": (F.min, F.least), "high": (F.max, F.greatest)}).select("id", "low", "high")
    t = stage(t.join(spans, "id"), "cut-spans")
    apart = other.where("pre_a + nd_a <= pre_b").select("a", "b")
    above = t.select(F.col("id").alias("parent"), F.col("pre").alias("p"), F.col("nd").alias("n"), F.col("parent").alias("grand"))
    leaving = t.join(above, "parent").where("grand is not null and (low < p or high >= p + n)").select(F.col("id").alias("a"), F.col("parent").alias("b"))
    joined = apart.unionByName(leaving)
    both = joined.unionByName(joined.select(F.col("b").alias("a"), F.col("a").alias("b")))
    block = stage(least_labels(t.where("parent is not null"), both), "cut-blocks")
    touches = block.join(t.select("id", "parent"), "id").select(F.explode(F.array("id", "parent")).alias("id"), "component")
    return touches.groupBy("id").agg(F.countDistinct("component").alias("k")).where("k > 1").select("id")


def articulation_points(graph: PropertyGraph, small: int = SMALL_LINKS) -> DataFrame:
    """(id) of the nodes whose removal splits their component, ignoring directions.

    Nodes of one neighbour are peeled off first, again and again: a leaf is no cut point, its neighbour is one
    exactly if it has another neighbour. What remains of a component goes through an exact low-point search in
    one task if it has at most ``small`` links, and otherwise through the same search by levels of a tree.
    """
    pairs = stage(graph.undirected(), "cut-links")
    member = stage(least_labels(graph.nodes, pairs).select(F.col("id").alias("a"), "component"), "cut-parts")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"id": _cut_points(pdf["a"].to_numpy(), pdf["b"].to_numpy())}, dtype="int64")

    cuts, rest = None, pairs
    for _ in range(3):
        degree = rest.groupBy("a").agg(F.count("*").alias("d"))
        leaves = degree.where("d = 1").select("a")
        hung = rest.join(leaves, "a", "left_semi").select(F.col("b").alias("a")).distinct()
        # a neighbour with two or more links left is a cut point; of a lone pair neither is
        new = hung.join(degree.where("d > 1"), "a", "left_semi").select(F.col("a").alias("id"))
        new = stage(new, "cut-found")
        cuts = new if cuts is None else cuts.unionByName(new)
        rest = stage(rest.join(leaves, "a", "left_anti").join(leaves.withColumnRenamed("a", "b"), "b", "left_anti").select("a", "b"), "cut-links")
    parts = rest.join(member, "a")
    large = stage(parts.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > small).select("component"), "cut-large")
    found = parts.join(large, "component", "left_anti").groupBy("component").applyInPandas(run, "id bigint")
    if not large.isEmpty():
        big = stage(parts.join(large, "component", "left_semi").select("a", "b"), "cut-big")
        # peeling may have taken a component's least node, so the rest is named anew
        ids = big.select(F.col("a").alias("id")).distinct()
        found = found.unionByName(_cut_points_at_any_size(big, least_labels(ids, big).select(F.col("id").alias("a"), "component")))
    return cuts.unionByName(found).distinct()


def _dependencies(a: np.ndarray, b: np.ndarray, source: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, dependency) of one breadth-first search; a node's dependency splits equally over predecessors."""
    ids, inverse = np.unique(np.concatenate((a, b, [source])), return_inverse=True)
    head, tail = inverse[: len(a)], inverse[len(a) : 2 * len(a)]
    depth = np.full(len(ids), -1)
    depth[inverse[-1]] = d = 0
    while True:
        fresh = np.unique(tail[(depth[head] == d) & (depth[tail] < 0)])
        if not len(fresh):
            break
        d += 1
        depth[fresh] = d
    dag = (depth[head] >= 0) & (depth[tail] == depth[head] + 1)
    head, tail = head[dag], tail[dag]
    before = np.bincount(tail, minlength=len(ids))
    flow = np.zeros(len(ids))
    for level in range(d, 0, -1):
        here = depth[tail] == level
        np.add.at(flow, head[here], (1 + flow[tail[here]]) / before[tail[here]])
    flow[inverse[-1]] = 0
    return ids, flow


def approx_betweenness(graph: PropertyGraph, sources: int = 64, small: int = SMALL_LINKS) -> DataFrame:
    """(id, betweenness) from breadth-first searches of the first ``sources`` nodes by id.

    The dependency of a node is split equally over its predecessors on shortest paths, from the deepest
    level upwards; a source gets none of its own. Nodes outside all searches get 0. With at most ``small``
    links each task gets them all and does whole searches; with more, all searches advance level by level.
    """
    ids = graph.nodes.select("id")
    l = stage(links(graph).where("a <> b"), "between-links")
    first = graph.nodes.select("id").orderBy("id").limit(sources)
    if l.count() <= small:
        pairs = l.toPandas()  # at most ``small`` rows
        shared = graph.nodes.sparkSession.sparkContext.broadcast((pairs["a"].to_numpy(), pairs["b"].to_numpy()))

        def search(batches):
            for pdf in batches:
                for source in pdf["id"]:
                    node, flow = _dependencies(*shared.value, source)
                    yield pd.DataFrame({"id": node[flow > 0], "x": flow[flow > 0]})

        part = first.repartition(min(sources, 16)).mapInPandas(search, "id bigint, x double")
        return _summed(ids, part)
    levels = stage(reach(first.select(F.col("id").alias("source"), "id"), l, None, "between"), "between-levels")
    deepest = levels.agg(F.max("depth").alias("d")).collect()[0].d or 0  # one number
    up = levels.select("source", F.col("id").alias("b"), F.col("depth").alias("db"))
    before = stage(up.join(l, "b").join(levels.select("source", F.col("id").alias("a"), F.col("depth").alias("da")), ["source", "a"]).where("da + 1 = db").select("source", "a", "b", "db"), "between-dag")
    shares = before.groupBy("source", "b").agg(F.count("*").alias("k"))
    before = stage(before.join(shares, ["source", "b"]), "between-dag")
    total, below = None, None
    for d in range(deepest, 0, -1):
        here = before.where(F.col("db") == d)
        if below is None:
            flow = here.select("source", "a", (F.lit(1.0) / F.col("k")).alias("x"))
        else:
            flow = here.join(below.withColumnRenamed("id", "b"), ["source", "b"], "left").select("source", "a", ((1.0 + F.coalesce("x", F.lit(0.0))) / F.col("k")).alias("x"))
        below = stage(flow.groupBy("source", F.col("a").alias("id")).agg(F.sum("x").alias("x")), "between-flow")
        part = below.where("id <> source")
        total = part if total is None else total.unionByName(part)
    return ids.withColumn("betweenness", F.lit(0.0)) if total is None else _summed(ids, total)


def _summed(ids: DataFrame, total: DataFrame) -> DataFrame:
    return ids.join(total.groupBy("id").agg(F.sum("x").alias("betweenness")), "id", "left").select("id", F.coalesce("betweenness", F.lit(0.0)).alias("betweenness"))


def bridge_scores(graph: PropertyGraph, communities: DataFrame, sources: int = 64) -> DataFrame:
    """(id, score, communities_touched, degree, betweenness, articulation), score > 0.

    3 x communities among the neighbours + degree + sqrt(betweenness) + 12 if a cut point.
    communities has (id, community).
    """
    c = communities.select("id", "community")
    ends = graph.edges.select(F.explode(F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b")))).alias("p")).select("p.*").distinct()
    touched = ends.join(c.select(F.col("id").alias("b"), "community"), "b").groupBy(F.col("a").alias("id")).agg(F.countDistinct("community").alias("communities_touched"))
    cut = articulation_points(graph).withColumn("articulation", F.lit(True))
    j = graph.degrees().select("id", "degree").join(touched, "id", "left").join(approx_betweenness(graph, sources), "id", "left").join(cut, "id", "left")
    j = j.na.fill(0, ["communities_touched", "betweenness"]).withColumn("articulation", F.coalesce("articulation", F.lit(False)))
    score = 3.0 * F.col("communities_touched") + F.col("degree") + F.sqrt("betweenness") + F.when(F.col("articulation"), 12.0).otherwise(0.0)
    return j.withColumn("score", score).where("score > 0").select("id", "score", "communities_touched", "degree", "betweenness", "articulation")
