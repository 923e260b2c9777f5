"""Graphs and dictionaries at rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import Graph


def write_graph(graph: Graph, path: str) -> None:
    """Nodes and edges as Parquet, edges sorted by source within files, so that scans by source prune."""
    graph.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    graph.edges.repartitionByRange("src", "dst").sortWithinPartitions("src", "dst").write.mode("overwrite").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> Graph:
    return Graph(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"))


def adjacency_text(graph: Graph) -> DataFrame:
    """(value): one line for each node with outgoing edges, its id and its neighbours."""
    return graph.adjacency().select(F.concat(F.col("id").cast("string"), F.lit(": "), F.array_join(F.transform("neighbors", lambda x: x.cast("string")), " ")).alias("value"))


def write_text(graph: Graph, path: str) -> None:
    adjacency_text(graph).write.mode("overwrite").text(path)


def first_answers(log: DataFrame) -> DataFrame:
    """A replayed log (pos, job, result; pos of any type that has an order) with the first answer to each job."""
    return log.groupBy("job").agg(F.min_by("result", "pos").alias("result"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(pos, job, result): a folder of answers as ``serve`` and ``Jobs.explore`` leave it, older files first."""
    rows = spark.read.parquet(path).select("job", "result", F.col("_metadata.file_modification_time").alias("t"), F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("i"))
    return rows.select(F.struct("t", "f", "i").alias("pos"), "job", "result")
