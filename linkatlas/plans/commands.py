"""The job language: graph letter, command letter, node number, each answered by one row of JSON."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.formats import permutation
from ..operators import traversal
from ..scratch import cut
from ..sources.store import first_answers
from .build import Wiki

TOP, JOB_LENGTH = 100, 100


class Jobs:
    """Answers jobs over a wiki's two graphs and keeps the answers, so that a repeated job is not computed again.

    a or c, then D<node> distances, S component sizes, I<node> degrees, R ranks.
    """

    def __init__(self, wiki: Wiki, top: int = TOP) -> None:
        self.wiki, self.top = wiki, top
        self.spark: SparkSession = wiki.page.sparkSession
        self.kept: dict[str, DataFrame] = {}
        self.total = wiki.nodes.count()

    def run(self, job: str) -> DataFrame:
        """One row: job, result."""
        job = job[:JOB_LENGTH]
        if job not in self.kept:
            self.kept[job] = cut(self._answer(job), "answers")
        return self.kept[job]

    def run_all(self, jobs: list[str]) -> DataFrame:
        """Answers to all jobs. Distances and degrees take one pass over each graph, however many nodes are asked for."""
        jobs = list(dict.fromkeys(job[:JOB_LENGTH] for job in jobs))
        for (kind, command), nodes in self._batches([j for j in jobs if j not in self.kept]).items():
            ids = self.spark.createDataFrame([(n,) for n in nodes], "id long")
            graph = self._graph(kind)
            if command == "D":
                found = traversal.count_arrays(traversal.search(graph, ids)).select(F.col("source").alias("id"), F.struct("count_dist").alias("r"))
            else:
                found = graph.degrees().join(ids, "id", "left_semi").select("id", F.struct("in_degree", "out_degree").alias("r"))
            done = cut(found.select(F.concat(F.lit(kind + command), F.col("id").cast("string")).alias("job"), F.to_json("r").alias("result")), "answers")
            for n in nodes:
                self.kept[f"{kind}{command}{n}"] = done.where(F.col("job") == f"{kind}{command}{n}")
        out = self.spark.createDataFrame([], "job string, result string")
        for job in jobs:
            out = out.unionByName(self.run(job))
        return out

    def _batches(self, jobs: list[str]) -> dict[tuple[str, str], list[int]]:
        """Of jobs that name a sound node in its plain form, the nodes by graph and command, where there are several."""
        found: dict[tuple[str, str], list[int]] = {}
        for job in jobs:
            if m := re.fullmatch(r"([ac])([DI])([1-9]\d*)", job):
                if int(m[3]) <= self.total:
                    found.setdefault((m[1], m[2]), []).append(int(m[3]))
        wrong: set[int] = set()
        if asked := [n for (kind, _), nodes in found.items() if kind == "a" for n in nodes]:
            wrong = {r["graph_id"] for r in self.wiki.nodes.where(F.col("graph_id").isin(asked) & F.col("is_category")).select("graph_id").collect()}
        found = {k: [n for n in nodes if k[0] == "c" or n not in wrong] for k, nodes in found.items()}
        return {k: nodes for k, nodes in found.items() if len(nodes) > 1}

    def resume(self, jobs: list[str], log: DataFrame) -> DataFrame:
        """Answers to all jobs: the first one in a log (pos, job, result) where there is one, computed where there is none."""
        asked = self.spark.createDataFrame([(j,) for j in dict.fromkeys(jobs)], "job string")
        todo = [r["job"] for r in self.missing(asked, log).collect()]
        return first_answers(log).join(asked, "job", "left_semi").unionByName(self.run_all(todo))

    def explore(self, path: str, sample: int, seed: int = 42) -> None:
        """Fill a folder of answers with category distances of ``sample`` nodes by permutation; nothing is returned."""
        ids = permutation(self.spark, self.total, seed, sample).select(F.col("k").alias("id"))
        found = traversal.count_arrays(traversal.search(self.wiki.category_graph, ids))
        rows = found.select(F.concat(F.lit("cD"), F.col("source").cast("string")).alias("job"), F.to_json(F.struct("count_dist")).alias("result"))
        rows.write.mode("append").parquet(path)

    @staticmethod
    def missing(jobs: DataFrame, log: DataFrame) -> DataFrame:
        """Jobs (job) without an answer in a log (pos, job, result), of which the first answer counts."""
        return jobs.join(log.select("job").distinct(), "job", "left_anti")

    def _graph(self, kind: str):
        return self.wiki.article_graph if kind == "a" else self.wiki.category_graph

    def _row(self, job: str, result: str) -> DataFrame:
        return self.spark.createDataFrame([(job, result)], "job string, result string")

    def _error(self, job: str, text: str) -> DataFrame:
        return self._row(job, json.dumps({"error": text}, separators=(",", ":")))

    def _answer(self, job: str) -> DataFrame:
        m = re.match(r"([ac])([DSIR])(\d*)", job)
        if not m:
            return self._error(job, "Unknown command")
        kind, command, node = m[1], m[2], int(m[3]) if m[3] else None
        if node is not None:
            if not 1 <= node <= self.total:
                return self._error(job, "Node out of range")
            if kind == "a" and self.wiki.nodes.where((F.col("graph_id") == node) & F.col("is_category")).limit(1).count():
                return self._error(job, "Node is category")
        elif command in "DI":
            return self._error(job, "Node out of range")
        graph = self._graph(kind)
        if command == "D":
            reached = traversal.distances(graph, self.spark.range(node, node + 1))
            return traversal.count_arrays(reached).select(F.lit(job).alias("job"), F.to_json(F.struct("count_dist")).alias("result"))
        if command == "I":
            return graph.degrees().where(F.col("id") == node).select(F.lit(job).alias("job"), F.to_json(F.struct("in_degree", "out_degree")).alias("result"))
        if command == "S":
            sizes = traversal.sizes(traversal.strong(graph) if kind == "a" else traversal.connected(graph))
            rows = F.array_sort(F.collect_list(F.struct("size", "count")))
            text = F.concat(F.lit('{"components":['), F.array_join(F.transform(rows, lambda x: F.format_string("[%d,%d]", x["size"], x["count"])), ","), F.lit("]}"))
            return sizes.agg(text.alias("result")).select(F.lit(job).alias("job"), "result")
        ranks, _ = traversal.pagerank(graph)
        top = ranks.orderBy(F.desc(F.round("rank", 9)), F.desc("id")).limit(self.top)
        rows = F.sort_array(F.collect_list(F.struct(F.round("rank", 9).alias("r"), F.col("id").alias("n"))), asc=False)
        text = F.concat(F.lit('{"ranks":['), F.array_join(F.transform(rows, lambda x: F.format_string("[%.6f,%d]", x["r"], x["n"])), ","), F.lit("]}"))
        return top.agg(text.alias("result")).select(F.lit(job).alias("job"), "result")
