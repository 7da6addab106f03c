"""A typed, weighted, directed property multigraph held as two DataFrames.

nodes: id, kind, name, qualified_name, source_uri, line_start, line_end, is_test, properties, valid_from, valid_to,
source_text. edges: edge_id, src, dst, kind, confidence, conf_class, call_scope, call_receiver, resolved_from,
properties, valid_from, valid_to. Every operation returns a new graph; nothing is changed in place.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from knotwork.session import read_table

NODE_COLUMNS = ("kind", "name", "qualified_name", "source_uri", "line_start", "line_end", "is_test")
EDGE_COLUMNS = ("kind", "confidence", "conf_class")
PLACEHOLDER = "call::"


def is_placeholder(name: Column) -> Column:
    return name.startswith(PLACEHOLDER)


@dataclass(frozen=True)
class PropertyGraph:
    nodes: DataFrame
    edges: DataFrame

    # ---- loading -------------------------------------------------------------------------------
    @staticmethod
    def load(spark: SparkSession, folder: str, node_columns: Sequence[str] = NODE_COLUMNS, edge_columns: Sequence[str] = EDGE_COLUMNS) -> PropertyGraph:
        """The graph of the latest snapshot: one row per node id and edge id, edges with both ends.

        Of repeated rows the one delivered last counts. Only the named columns are read, so the scan of
        a query that needs no source text never touches it.
        """
        nodes = latest(read_table(spark, folder, "nodes"), "id", "delivered_at", node_columns)
        edges = latest(read_table(spark, folder, "edges").withColumnsRenamed({"src_id": "src", "dst_id": "dst"}), "edge_id", "ingested_at", ("src", "dst", *edge_columns))
        return PropertyGraph(nodes, edges).with_both_ends()

    def with_both_ends(self) -> PropertyGraph:
        ids = self.nodes.select("id")
        kept = self.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
        return replace(self, edges=kept)

    def register(self) -> None:
        """Temp views ``graph_nodes`` and ``graph_edges`` for Spark SQL."""
        self.nodes.createOrReplaceTempView("graph_nodes")
        self.edges.createOrReplaceTempView("graph_edges")

    # ---- look-ups ------------------------------------------------------------------------------
    def find(self, qualified_name: str) -> DataFrame:
        return self.nodes.where(F.col("qualified_name") == qualified_name)

    def counts(self) -> DataFrame:
        n = self.nodes.agg(F.count("*").alias("nodes"))
        return n.select("nodes", self.edges.agg(F.count("*").alias("edges")).scalar().alias("edges"))

    def has_edge_kind(self, kind: str) -> DataFrame:
        """Node ids that are the source of an edge of this kind."""
        return self.nodes.select("id").join(self.edges.where(F.col("kind") == kind).select(F.col("src").alias("id")), "id", "left_semi")

    def out_neighbours(self) -> DataFrame:
        """(id, neighbour, kind) over outgoing edges, multi-edges kept."""
        return self.edges.select(F.col("src").alias("id"), F.col("dst").alias("neighbour"), "kind")

    def in_neighbours(self) -> DataFrame:
        return self.edges.select(F.col("dst").alias("id"), F.col("src").alias("neighbour"), "kind")

    def degrees(self) -> DataFrame:
        """(id, in_degree, out_degree, degree) of every node; multi-edges count each."""
        ends = self.edges.select(F.explode(F.array(
            F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")),
            F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
        # one exchange for both directions: partial sums per node, then the merge with the node list
        zero = self.nodes.select("id", F.lit(0).alias("o"), F.lit(0).alias("i"))
        d = ends.unionByName(zero).groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
        return d.withColumn("degree", F.col("in_degree") + F.col("out_degree"))

    def undirected(self) -> DataFrame:
        """Distinct (a, b) in both directions, without loops."""
        both = self.edges.where("src <> dst").select(F.explode(F.array(
            F.struct(F.col("src").alias("a"), F.col("dst").alias("b")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b")))).alias("e"))
        return both.select("e.a", "e.b").distinct()

    # ---- changes -------------------------------------------------------------------------------
    def add_nodes(self, new: DataFrame, keep_existing: bool = False) -> PropertyGraph:
        """Upsert by qualified_name. The new payload wins, or with ``keep_existing`` the old one; ids stay."""
        old = self.nodes.withColumn("_new", F.lit(0))
        rows = old.unionByName(new.select(*[c for c in self.nodes.columns]).withColumn("_new", F.lit(1)))
        name = Window.partitionBy("qualified_name")
        pick = F.row_number().over(name.orderBy(F.col("_new").asc() if keep_existing else F.col("_new").desc(), F.desc("id")))
        rows = rows.withColumn("_id", F.min_by("id", F.struct("_new", "id")).over(name)).withColumn("_r", pick).where("_r = 1")
        return replace(self, nodes=rows.withColumn("id", F.col("_id")).select(*self.nodes.columns))

    def add_edges(self, new: DataFrame) -> PropertyGraph:
        """Append; a multigraph keeps equal edges."""
        return replace(self, edges=self.edges.unionByName(new.select(*self.edges.columns)))

    def remove_nodes(self, ids: DataFrame) -> PropertyGraph:
        """Drop the nodes of ``ids`` (id) with their edges."""
        gone = ids.select("id").distinct()
        edges = self.edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
        return PropertyGraph(self.nodes.join(gone, "id", "left_anti"), edges.select(*self.edges.columns))

    def remove_edges(self, ids: DataFrame) -> PropertyGraph:
        return replace(self, edges=self.edges.join(ids.select("edge_id"), "edge_id", "left_anti").select(*self.edges.columns))

    def merge_nodes(self, mapping: DataFrame) -> PropertyGraph:
        """Merge losers into winners by ``mapping`` (loser, winner): rewire, drop loops and equal edges.

        Of edges with equal (src, dst, kind) the one that was there before the merge stays, then the lowest
        edge_id. A winner that loses elsewhere in the mapping isn't followed: pass final winners.
        """
        m = mapping.select("loser", "winner").where("loser <> winner")
        moved = self.edges.join(m.select(F.col("loser").alias("src"), F.col("winner").alias("_s")), "src", "left").join(
            m.select(F.col("loser").alias("dst"), F.col("winner").alias("_d")), "dst", "left")
        moved = moved.withColumn("_moved", F.col("_s").isNotNull() | F.col("_d").isNotNull())
        moved = moved.withColumn("src", F.coalesce("_s", "src")).withColumn("dst", F.coalesce("_d", "dst"))
        moved = moved.where("not (_moved and src = dst)")
        first = Window.partitionBy("src", "dst", "kind").orderBy("_moved", "edge_id")
        kept = moved.withColumn("_r", F.row_number().over(first)).where("_r = 1 or not _moved").select(*self.edges.columns)
        return PropertyGraph(self.nodes.join(m.select(F.col("loser").alias("id")), "id", "left_anti"), kept)

    def rename(self, old: str, new: str) -> PropertyGraph:
        """Rename a node; if the new name exists, merge the old node into that one."""
        taken = self.find(new).select(F.col("id").alias("winner"))
        mapping = self.find(old).select(F.col("id").alias("loser")).join(F.broadcast(taken))  # at most one row a side
        g = self.merge_nodes(mapping)
        leaf = F.element_at(F.split(F.lit(new), "::"), -1)
        hit = F.col("qualified_name") == old
        return replace(g, nodes=g.nodes.withColumn("name", F.when(hit, leaf).otherwise(F.col("name"))).withColumn("qualified_name", F.when(hit, F.lit(new)).otherwise(F.col("qualified_name"))))

    def union(self, other: PropertyGraph) -> PropertyGraph:
        """Union by qualified_name: existing nodes keep their payload, loops and equal (src, dst, kind) go."""
        mine, theirs = self.nodes.select("qualified_name", F.col("id").alias("_mine")), other.nodes.select("qualified_name", "id")
        # ids of the other graph's new nodes are moved past this graph's
        shift = self.nodes.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).scalar()
        ids = theirs.join(mine, "qualified_name", "left").select("id", F.coalesce("_mine", F.col("id") + shift).alias("to"), F.col("_mine").isNull().alias("fresh"))
        fresh = other.nodes.join(ids.where("fresh").select("id", "to"), "id").withColumn("id", F.col("to")).select(*self.nodes.columns)
        rewired = other.edges.join(ids.select(F.col("id").alias("src"), F.col("to").alias("_s")), "src").join(ids.select(F.col("id").alias("dst"), F.col("to").alias("_d")), "dst")
        rewired = rewired.withColumn("src", F.col("_s")).withColumn("dst", F.col("_d")).where("src <> dst").select(*self.edges.columns)
        first = Window.partitionBy("src", "dst", "kind").orderBy("_other", "edge_id")
        both = self.edges.withColumn("_other", F.lit(0)).unionByName(rewired.withColumn("_other", F.lit(1)))
        kept = both.withColumn("_r", F.row_number().over(first)).where("_other = 0 or _r = 1").select(*self.edges.columns)
        return PropertyGraph(self.nodes.unionByName(fresh), kept)


def latest(rows: DataFrame, key: str, when: str, columns: Sequence[str]) -> DataFrame:
    """One row per non-null ``key``: the one with the greatest (when, columns...), nulls least."""
    picked = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(when, *columns)).alias("_r"))
    return picked.select(key, *[F.col(f"_r.{c}").alias(c) for c in columns])


def graph_sql(node_columns: Sequence[str] = NODE_COLUMNS, edge_columns: Sequence[str] = EDGE_COLUMNS) -> str:
    """The CTEs n and e: the same graph in SQL."""
    order = lambda cols: ", ".join(f"{c} DESC NULLS LAST" for c in cols)
    ends = ("src", "dst", *edge_columns)
    return f"""
n AS (SELECT id, {", ".join(node_columns)} FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY {order(("delivered_at", *node_columns))}) AS rn FROM nodes WHERE id IS NOT NULL) WHERE rn = 1),
e AS (SELECT edge_id, {", ".join(ends)} FROM (SELECT *, row_number() OVER (PARTITION BY edge_id ORDER BY {order(("ingested_at", *ends))}) AS rn
  FROM (SELECT *, src_id AS src, dst_id AS dst FROM edges WHERE edge_id IS NOT NULL)) WHERE rn = 1 AND src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n))"""
