"""The combined report over both graphs, its state as JSON, and a page that shows it."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metrics
from ..functions.formats import percent, permutation, pretty
from ..operators import traversal
from ..scratch import cut
from .build import Wiki


def analyze(wiki: Wiki, sample: int | None = None, seed: int = 42, top: int = 100) -> dict[str, DataFrame]:
    """Every table of the report. ``sample`` limits the sources of the distance search to so many nodes, by permutation; None takes all."""
    spark = wiki.page.sparkSession
    n = wiki.nodes.count()
    picked = permutation(spark, n, seed, n if sample is None else sample).select(F.col("k").alias("id"))
    out = {"counters": wiki.counters}
    tops = []
    for kind, graph in (("article", wiki.article_graph), ("category", wiki.category_graph)):
        labels = traversal.strong(graph) if kind == "article" else traversal.connected(graph)
        sizes = cut(traversal.sizes(labels), "sizes")
        largest = sizes.agg(F.max("size")).first()[0] or 0
        sources = picked.join(graph.nodes, "id", "left_semi")
        reached = cut(traversal.search(graph, sources), "distances")
        near = cut(metrics.closeness(reached), "closeness")
        out |= {f"{kind}_components": sizes, f"{kind}_components_largest_first": metrics.largest_first(sizes), f"{kind}_coverage": metrics.coverage(near, graph.nodes.count())}
        out |= {f"{kind}_spectrum": metrics.spectrum(reached), f"{kind}_spectrum_shown": metrics.shown(metrics.spectrum(reached), metrics.SPECTRUM_SHOWN), f"{kind}_totals": metrics.totals(near, largest), f"{kind}_histograms": traversal.count_arrays(reached), f"{kind}_degrees": graph.degrees()}
        if largest:
            out[f"{kind}_closeness"] = cut(metrics.most_central(near, largest, top), "central")
            tops.append(out[f"{kind}_closeness"].select(F.col("source").alias("id")))
    ranks, _ = traversal.pagerank(wiki.article_graph)
    out["article_ranks"] = cut(ranks.orderBy(F.desc(F.round("rank", 9)), F.desc("id")).limit(top), "ranks")
    out["article_rank_percent"] = out["article_ranks"].select("id", percent(F.round("rank", 9), 3).alias("percent"))
    chosen = out["article_ranks"].select("id")
    for t in tops:
        chosen = chosen.union(t)
    out["interesting"] = chosen.distinct().join(wiki.nodes.select(F.col("graph_id").alias("id"), pretty(F.col("ns"), F.col("title")).alias("name")), "id")
    return out


def detail(wiki: Wiki, ids: DataFrame) -> DataFrame:
    """For each of ``ids`` (id): name, degrees and histogram in each graph; zero and empty where it is no node."""
    named = wiki.nodes.select(F.col("graph_id").alias("id"), pretty(F.col("ns"), F.col("title")).alias("name"))
    out = ids.select("id").distinct().join(named, "id")
    for kind, graph in (("article", wiki.article_graph), ("category", wiki.category_graph)):
        sources = ids.select("id").distinct().join(graph.nodes, "id", "left_semi")
        d = graph.degrees().join(sources, "id", "left_semi").select("id", F.col("in_degree").alias(f"{kind}_in"), F.col("out_degree").alias(f"{kind}_out"))
        h = traversal.count_arrays(traversal.search(graph, sources)).select(F.col("source").alias("id"), F.col("count_dist").alias(f"{kind}_dist"))
        out = out.join(d, "id", "left").join(h, "id", "left")
        out = out.fillna(0, [f"{kind}_in", f"{kind}_out"]).withColumn(f"{kind}_dist", F.coalesce(f"{kind}_dist", F.array().cast("array<long>")))
    return out


def save(report: dict[str, DataFrame], path: str) -> None:
    for name, df in report.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def load(spark, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.json(f"{path}/{n}") for n in names}


def page(report: dict[str, DataFrame], rows: int = 100) -> str:
    """An HTML page with the first rows of each table."""
    parts = []
    for name, df in report.items():
        got = df.limit(rows).collect()
        head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
        body = "".join("<tr>" + "".join(f"<td>{html.escape(v if isinstance(v, str) else json.dumps(v))}</td>" for v in r) + "</tr>" for r in got)
        parts.append(f"<h2>{html.escape(name)}</h2><table><tr>{head}</tr>{body}</table>")
    return "<!DOCTYPE html><meta charset=utf-8><title>Link graph report</title>" + "".join(parts)
