"""Graphs as a table of nodes (id) and a bag of edges (src, dst)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Graph:
    """Edges may be parallel or loops, nodes may be isolated, edge ends need not be nodes (see ``inner``)."""

    nodes: DataFrame
    edges: DataFrame

    def inner(self) -> Graph:
        """Only edges between nodes."""
        e = self.edges.join(self.nodes.withColumnRenamed("id", "src"), "src", "left_semi").join(self.nodes.withColumnRenamed("id", "dst"), "dst", "left_semi")
        return Graph(self.nodes, e.select("src", "dst"))

    def transpose(self, first: int | None = None, last: int | None = None) -> Graph:
        """Edges turned around, of those into [first, last] if given."""
        e = self.edges
        if first is not None:
            e = e.where(F.col("dst") >= first)
        if last is not None:
            e = e.where(F.col("dst") <= last)
        return Graph(self.nodes, e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))

    def add(self, other: Graph) -> Graph:
        """Both graphs' edges, on the union of their nodes."""
        nodes = self.nodes if other.nodes is self.nodes else self.nodes.unionByName(other.nodes).distinct()
        return Graph(nodes, self.edges.unionByName(other.edges))

    def degrees(self) -> DataFrame:
        """(id, in_degree, out_degree) for every node, parallel edges counted: one shuffle of partial sums."""
        ends = self.edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e")).select("e.*")
        sums = ends.unionByName(self.nodes.select("id", F.lit(0).alias("i"), F.lit(0).alias("o"))).groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
        return sums.join(self.nodes, "id", "left_semi").select("id", "in_degree", "out_degree")

    def adjacency(self) -> DataFrame:
        """(id, neighbors) for nodes with an outgoing edge, neighbours in ascending order."""
        return self.edges.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list("dst")).alias("neighbors"))

    def stray_edges(self) -> DataFrame:
        """Edges that end at something that is not a node; a sane graph has none."""
        return self.edges.join(self.nodes.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst")

    def size(self) -> DataFrame:
        """One row: num_nodes, num_edges, stray_edges."""
        n = self.nodes.agg(F.count("*").alias("num_nodes"))
        e = self.edges.agg(F.count("*").alias("num_edges"))
        return n.crossJoin(e).crossJoin(self.stray_edges().agg(F.count("*").alias("stray_edges")))
