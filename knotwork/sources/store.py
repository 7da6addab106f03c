"""A graph on disk: Parquet tables of active rows, closed versions, file hashes; changed by whole new copies."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.functions.embedding import embed_nodes
from knotwork.graph import PropertyGraph
from knotwork.operators.search import bm25, build_index
from knotwork.operators.temporal import with_archive

TABLES = ("nodes", "edges", "node_archive", "edge_archive", "file_state", "embeddings", "postings", "lengths")


class Store:
    """Tables below one folder. Each table has generations; a pointer file names the current one.

    A write makes a new generation and then moves the pointer, so readers never see half a table and a lost
    executor costs only the tasks it ran.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _current(self, table: str) -> str | None:
        at = self._path(f"{self.folder}/{table}")
        if not self._fs.exists(at):
            return None
        done = [s.getPath().getName() for s in self._fs.listStatus(at) if self._fs.exists(self._path(f"{s.getPath().toString()}/_SUCCESS"))]
        return f"{self.folder}/{table}/{max(done)}" if done else None

    def exists(self, table: str) -> bool:
        return self._current(table) is not None

    def read(self, table: str) -> DataFrame:
        current = self._current(table)
        if current is None:
            raise FileNotFoundError(f"{self.folder} has no table {table}")
        return self.spark.read.parquet(current)

    def write(self, table: str, df: DataFrame) -> None:
        old = self._current(table)
        number = int(old.rsplit("/", 1)[-1].split("-")[0]) + 1 if old else 1
        df.write.parquet(f"{self.folder}/{table}/{number:010d}-{uuid.uuid4().hex[:8]}")
        if old:
            self._fs.delete(self._path(old), True)

    def append(self, table: str, df: DataFrame) -> None:
        self.write(table, self.read(table).unionByName(df.select(*self.read(table).columns)) if self.exists(table) else df)

    def save(self, graph: PropertyGraph) -> None:
        """Replace the active graph; all columns are kept, source_text too."""
        self.write("nodes", graph.nodes)
        self.write("edges", graph.edges)

    def load(self) -> PropertyGraph:
        return PropertyGraph(self.read("nodes"), self.read("edges"))

    def load_temporal(self) -> PropertyGraph:
        """Active rows and closed versions; the active row of a name wins. Edges need both ends."""
        nodes, edges = self.read("nodes"), self.read("edges")
        if self.exists("node_archive"):
            nodes = with_archive(nodes, self.read("node_archive"))
        if self.exists("edge_archive"):
            edges = with_archive(edges, self.read("edge_archive"), "edge_id")
        return PropertyGraph(nodes, edges).with_both_ends()

    def of_sources(self, sources: DataFrame) -> PropertyGraph:
        """Active nodes of the sources (source_uri) and the edges that touch them."""
        g = self.load()
        nodes = g.nodes.join(sources.select("source_uri").distinct(), "source_uri", "left_semi").select(*g.nodes.columns)
        ids = nodes.select("id")
        out, into = (g.edges.join(ids.withColumnRenamed("id", k), k, "left_semi").select(*g.edges.columns) for k in ("src", "dst"))
        return PropertyGraph(nodes, out.unionByName(into).dropDuplicates(["edge_id"]))

    def archive(self, graph: PropertyGraph, commit: str) -> None:
        """Close versions: valid_to is the commit, a missing birth is the same commit."""
        close = lambda df: df.withColumn("valid_to", F.lit(commit)).withColumn("valid_from", F.coalesce("valid_from", F.lit(commit)))
        self.append("node_archive", close(graph.nodes))
        self.append("edge_archive", close(graph.edges))

    def delete_sources(self, sources: DataFrame) -> None:
        """Drop the nodes of the sources, their edges, embeddings, entries of the text index and file hashes."""
        g = self.load()
        gone = g.nodes.join(sources.select("source_uri").distinct(), "source_uri", "left_semi").select("id")
        if self.exists("embeddings"):
            self.write("embeddings", self.read("embeddings").join(gone.withColumnRenamed("id", "node_id"), "node_id", "left_anti"))
        for t in ("postings", "lengths"):
            if self.exists(t):
                rows = self.read(t)
                self.write(t, rows.join(gone, "id", "left_anti").select(*rows.columns))
        if self.exists("file_state"):
            self.write("file_state", self.read("file_state").join(sources.select(F.col("source_uri").alias("path")), "path", "left_anti").select("path", "hash", "indexed_at"))
        left = g.remove_nodes(gone)
        self.write("edges", left.edges)
        self.write("nodes", left.nodes.select(*g.nodes.columns))

    def set_hashes(self, hashes: DataFrame, at: int) -> None:
        """Upsert (path, hash)."""
        new = hashes.select("path", "hash", F.lit(at).cast("bigint").alias("indexed_at"))
        old = self.read("file_state").join(new.select("path"), "path", "left_anti").select("path", "hash", "indexed_at") if self.exists("file_state") else None
        self.write("file_state", new if old is None else old.unionByName(new))

    def changed_files(self, hashes: DataFrame) -> DataFrame:
        """(path, change) of (path, hash) against the stored hashes: added, changed or deleted."""
        if not self.exists("file_state"):
            return hashes.select("path", F.lit("added").alias("change"))
        j = self.read("file_state").select("path", F.col("hash").alias("old")).join(hashes.select("path", "hash"), "path", "full")
        change = F.when(F.col("old").isNull(), "added").when(F.col("hash").isNull(), "deleted").when(F.col("old") != F.col("hash"), "changed")
        return j.select("path", change.alias("change")).where("change is not null")

    def rebuild_embeddings(self, model: str = "hash-384") -> None:
        """Embed all active nodes but placeholders anew."""
        self.write("embeddings", embed_nodes(self.read("nodes"), model))

    def rebuild_index(self) -> None:
        """The text index over kind, name and qualified name anew."""
        n = self.read("nodes")
        postings, lengths = build_index(n, "id", F.concat_ws(" ", "kind", "name", "qualified_name"))
        self.write("postings", postings)
        self.write("lengths", lengths)

    def search_text(self, query: str) -> DataFrame:
        return bm25(self.read("postings"), self.read("lengths"), "id", query)

    def stats(self) -> dict[str, int]:
        return {t: self.read(t).count() for t in TABLES if self.exists(t)}

    def has_history(self) -> bool:
        return any(not self.read(t).where("valid_from is not null or valid_to is not null").isEmpty() for t in ("nodes", "edges", "node_archive", "edge_archive") if self.exists(t))

    def reset(self) -> None:
        for t in TABLES:
            self._fs.delete(self._path(f"{self.folder}/{t}"), True)
