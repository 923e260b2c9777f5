"""Breadth-first search from many sources, components, and PageRank, each a driver loop of set operations."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import cut, free
from .bits import groups, search_group
from .cycles import components, joined_up
from .graph import Graph
from .hubs import FAR, KINDS, Part, class_counts, classes, closed, packed, part_rows, sums
from .numbering import dense_ids

DAMPING, TOLERANCE = 0.85, 1e-3
#: Words of 64 sources that one row of ``search`` carries.
WORDS = 16
#: Components of ``search``: under SMALL links and sources they share a task; beyond that a task has about SHARE sources x links of one,
#: which is dealt to up to PARTS tasks; over LINKS links, more than a task should hold, the rounds are joins.
SMALL, SHARE, PARTS, LINKS = 100_000, 2e9, 24, 64_000_000

#: ``search_through_hubs`` is tried for components of over WIDE sources x links, with up to HUBS hubs, and done if there are at most 1 / WORTH sums of
#: classes' distances for each source and link. A row holds CLASSES classes of nodes.
WIDE, HUBS, WORTH, CLASSES = 2e11, 128, 8, 4096
#: Links that a task of ``strong`` has of a block of near ids, and at most (the last task's too).
BLOCK, GATHER = 500_000, 4_000_000


@dataclass(frozen=True)
class Steps(Graph):
    """A graph whose edges (long) are written, each once, without loops, and end at nodes, which are distinct.

    ``half`` are those of one direction if the others are the same turned around.
    """

    half: DataFrame | None = None

    @property
    def either(self) -> DataFrame:
        """Edges that suffice where directions are ignored."""
        return self.edges if self.half is None else self.half


@dataclass(frozen=True)
class Pieces:
    """What is known of a graph before a search: ``degrees`` (id, into, ends), the results of ``connected`` and ``strong``, and
    ``hubs`` with the parts (id, label) that are left without them; None if none are found.
    """

    degrees: DataFrame
    joined: DataFrame
    cycles: DataFrame | None = None
    hubs: tuple[list[int], DataFrame] | None = None


def _degrees(edges: DataFrame) -> DataFrame:
    """(id, into, ends): how many links enter each end of links that occur once, and how many it is an end of."""
    both = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(1).alias("i")))).alias("e")).select("e.*")
    return cut(both.groupBy("id").agg(F.sum("i").alias("into"), F.count("*").alias("ends")), "degrees")


def pieces(graph: Steps, cycles: bool = False) -> Pieces:
    """Components, and hubs that leave at most half the work of a search from all nodes, each link looked at as few times as can be.

    With ``cycles`` strong components are found, and the plain ones of what is left when they are contracted. Without, hubs of
    far more links than other nodes are taken off first; the parts that are left and the hubs' links give the components.
    """
    degrees = _degrees(graph.edges)
    wide = float(graph.nodes.count()) * graph.edges.count() > WIDE
    top = _most_linked(degrees) if wide else []
    if cycles:
        both = strong_and_joined(graph)
        if not hasattr(both, "_scratch"):
            both = cut(both, "labels")
        found, joined = both.select("id", "label"), both.select("id", F.col("joined").alias("label"))
        hubs = _hubs(graph, found, degrees, top) if wide else None
        return Pieces(degrees, joined, found, hubs)
    if not top:
        return Pieces(degrees, cut(connected(Graph(graph.nodes, graph.either)), "labels"))
    rest = _without(Graph(graph.nodes, graph.either), top)
    # Parts are nodes of their own; to each hub there is one link of a part at most.
    at_hub = F.col("src").isin(top) | F.col("dst").isin(top)
    ends = graph.either.where(at_hub)
    for c in ("src", "dst"):
        ends = ends.join(rest.select(F.col("id").alias(c), F.col("label").alias(f"{c}_label")), c, "left").withColumn(c, F.coalesce(f"{c}_label", c)).select("src", "dst")
    ends = cut(ends.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), "rest")
    over = connected(Graph(ends.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), ends)).select(F.col("id").alias("root"), F.col("label").alias("over"))
    roots = rest.select("id", F.col("label").alias("root")).unionByName(graph.nodes.where(F.col("id").isin(top)).select("id", F.col("id").alias("root")))
    joined = cut(roots.join(over, "root", "left").select("id", F.coalesce("over", "root").alias("label")), "labels")
    return Pieces(degrees, joined, None, (top, rest) if _falls_apart(graph, degrees, top, rest) else None)


def distances(graph: Graph, sources: DataFrame) -> DataFrame:
    """(source, node, dist) for every node that each source (id) reaches, itself at 0."""
    out = cut(graph.edges.distinct(), "steps")
    seen = cut(sources.select(F.col("id").alias("source"), F.col("id").alias("node"), F.lit(0).alias("dist")).distinct(), "reached")
    parts, frontier, dist = [seen], seen, 0
    while not frontier.isEmpty():
        dist += 1
        met = frontier.select("source", F.col("node").alias("src")).join(out, "src").select("source", F.col("dst").alias("node")).distinct()
        for level in parts:
            met = met.join(level.select("source", "node"), ["source", "node"], "left_anti")
        frontier = cut(met.withColumn("dist", F.lit(dist)), "reached")
        if dist % 8 == 0 and dist > 1:
            merged = parts[0]
            for level in parts[1:]:
                merged = merged.unionByName(level)
            parts = [cut(merged, "reached")]
        parts.append(frontier)
    result = parts[0]
    for level in parts[1:]:
        result = result.unionByName(level)
    return result


def search(graph: Graph, sources: DataFrame, below: int | None = None, summed: bool = False, joined: DataFrame | None = None, cycles: DataFrame | None = None, known: Pieces | None = None, pooled: bool = False) -> DataFrame:
    """(source, dist, n): how many nodes each source (id) first reaches at each distance, itself at 0.

    With ``below`` only distances under it are asked for, and the walk ends there. ``summed`` gives (source, reachable, distances)
    instead: how many nodes are at distance 1 and more, and the sum of their distances, added up as the tasks walk.
    ``pooled`` gives rows (dist, n) that are added up over sources as far as a task has them together.
    ``joined`` and ``cycles`` are the results of ``connected`` and ``strong`` for this graph if they are known; ``joined`` must have all sources and ends of links. ``known`` is
    what ``pieces`` found of a graph that is ``Steps``.

    The links of a component meet in a task, which searches from its sources in memory (``bits``), so that no
    round is written. A component with many sources goes to up to ``PARTS`` tasks, each with a share of them; small
    components share a task. Those with over ``LINKS`` links are searched by joins. Repeated sources count once,
    null ones not at all; no sources give no rows.
    """
    spark = graph.edges.sparkSession
    picked = cut(sources.select(F.col("id").cast("long").alias("id")).where("id is not null").distinct(), "sources")
    written = None
    if isinstance(graph, Steps):
        edges = graph.edges
    else:
        edges = written = cut(graph.edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).where("src <> dst").distinct(), "steps")
    degrees = _degrees(edges) if known is None else known.degrees
    if known is not None:
        joined, cycles = known.joined, known.cycles
    elif joined is None:
        joined = connected(Graph(degrees.select("id").unionByName(picked).distinct(), edges))
    label = joined if known is not None else cut(joined, "labels")
    least, most = degrees.agg(F.min("id"), F.max("id")).first()
    kind = "int" if least is None or -(1 << 31) <= least and most < 1 << 31 else "long"
    own = cut(picked.join(label, "id").select("label", F.col("id").alias("node")), "own")
    m = degrees.where("into > 0").join(label, "id").groupBy("label").agg(F.sum("into").alias("m"))
    comps = own.groupBy("label").agg(F.count("*").alias("s"), F.min("node").alias("least"), F.max("node").alias("most")).join(m, "label", "left").select("label", "s", "least", "most", F.coalesce("m", F.lit(0).cast("long")).alias("m"))
    small = F.col("m") + F.col("s") < SMALL
    comps = cut(comps.withColumn("parts", F.when(small, 1).otherwise(F.least(F.lit(PARTS), F.ceil(F.col("s") / (64 * WORDS)), 1 + F.floor(F.col("s") * F.col("m").cast("double") / SHARE))).cast("int")), "components")
    through = None
    if not (wide := comps.where(F.col("s").cast("double") * F.col("m") > WIDE).select("label")).isEmpty():
        held = cut(label.join(wide, "label", "left_semi").select("id"), "held")
        # Often all links are of the one component.
        every = comps.join(wide, "label", "left_semi").agg(F.sum("m")).first()[0] == edges.count()
        of_wide = edges if every else cut(edges.join(held.withColumnRenamed("id", "src"), "src", "left_semi"), "steps")
        through = search_through_hubs(Graph(held, of_wide), picked.join(held, "id", "left_semi"), below, summed, cycles, *([known.hubs if known else None, pooled] if known or pooled else []))
        if through is not None:
            comps = cut(comps.join(wide, "label", "left_anti"), "components")
            edges = edges.limit(0) if every else edges.join(held.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst")
        if not every:
            free(of_wide)
        if through is not None and comps.isEmpty():
            if written is not None:
                free(written)
            return through
    # A node's links in lists of up to a million.
    into = edges.groupBy(F.col("dst").alias("id"), F.shiftright("src", 20).alias("_")).agg(F.collect_list(F.col("src").cast(kind)).alias("links"))
    into = cut(into.join(label, "id").select("label", F.col("id").alias("node"), "links"), "links")
    huge = comps.where(F.col("m") > LINKS)
    rest, large = comps.where(F.col("m") <= LINKS).agg(F.sum(F.when(small, F.col("m") + F.col("s"))), F.sum(F.when(~small, F.col("parts")))).first()
    bins = max(16, (rest or 0) // (5 * SMALL))
    comps = comps.where(F.col("m") <= LINKS).select("label", "parts", "least", "most", (~small).alias("large"), F.when(small, F.pmod(F.xxhash64("label"), F.lit(bins))).otherwise(F.col("label")).alias("bin"))
    # Near ids are likely to be near each other in the graph, so a task's sources have near ids.
    share = F.floor((F.col("node").cast("double") - F.col("least")) / (F.col("most").cast("double") - F.col("least") + 1) * F.col("parts"))
    dealt = own.join(comps, "label").select("large", "bin", F.least(share, F.col("parts") - 1).cast("int").alias("part"), "label", "node", F.lit(None).cast(f"array<{kind}>").alias("links"))
    shared = into.join(comps, "label").select("large", "bin", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "label", "node", "links")
    keys = ["large", "bin", "part"]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(2000, bins + 2 * (large or 0)))
    rows = dealt.unionByName(shared).repartition(tasks, *keys).sortWithinPartitions(*keys)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, keys):
            label, node = (group.column(c).to_numpy() for c in ("label", "node"))
            links = group.column("links").combine_chunks()
            found = search_group(label, node, links.is_null().to_numpy(zero_copy_only=False), links, WORDS, below)
            if summed:
                yield from added(found)
                continue
            for source, dist, n in found:
                if pooled:
                    yield pa.record_batch([np.full(1, dist, np.int32), n.sum(keepdims=True)], names=["dist", "n"])
                    continue
                some = n > 0
                yield pa.record_batch([source[some], np.full(int(some.sum()), dist, np.int32), n[some]], names=["source", "dist", "n"])

    def added(found: Iterator[tuple[np.ndarray, int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        block = None
        for source, dist, n in found:
            if dist == 0:
                if block is not None:
                    yield pa.record_batch(block, names=["source", "reachable", "distances"])
                block = [source, np.zeros(len(source), np.int64), np.zeros(len(source), np.int64)]
            else:
                block[1] += n
                block[2] += dist * n
        if block is not None:
            yield pa.record_batch(block, names=["source", "reachable", "distances"])

    out = rows.mapInArrow(walk, "source long, reachable long, distances long" if summed else "dist int, n long" if pooled else "source long, dist int, n long")
    if through is not None:
        out = out.unionByName(through)
    if huge.isEmpty():
        if written is not None:
            free(written)
        return out
    held = label.join(huge.select("label"), "label", "left_semi").select("id")
    beyond = Graph(held, edges.join(held.withColumnRenamed("id", "src"), "src", "left_semi"))
    last = search_by_joins(beyond, picked.join(held, "id", "left_semi"), below)
    if summed:
        last = last.groupBy("source").agg(F.sum(F.when(F.col("dist") >= 1, F.col("n")).otherwise(0)).alias("reachable"), F.sum(F.col("dist") * F.col("n")).alias("distances"))
    return out.unionByName(last.select("dist", "n") if pooled else last)


def _most_linked(degrees: DataFrame) -> list[int]:
    """The nodes of far more links than all others, up to ``HUBS``."""
    top = degrees.orderBy(F.desc("ends"), "id").limit(HUBS + 1).collect()
    falls = [a["ends"] / b["ends"] for a, b in zip(top, top[1:])]
    return sorted(r["id"] for r in top[: falls.index(max(falls)) + 1]) if falls and max(falls) >= 1.5 else []


def _without(graph: Graph, hubs: list[int]) -> DataFrame:
    """(id, label): the plain components that are left without the hubs."""
    rest = cut(graph.nodes.where(~F.col("id").isin(hubs)), "held")
    return cut(connected(Graph(rest, graph.edges.where(~F.col("src").isin(hubs) & ~F.col("dst").isin(hubs)))), "labels")


def _falls_apart(graph: Graph, degrees: DataFrame, hubs: list[int], label: DataFrame) -> bool:
    """Whether the parts are at most half the work of the whole, and none has more links than a task should hold."""
    part = label.join(degrees.where(~F.col("id").isin(hubs)), "id", "left").groupBy("label").agg(F.count("*").alias("s"), F.sum("into").alias("m"))
    work, most = part.agg(F.sum(F.col("s") * F.col("m").cast("double")), F.max("m")).first()
    return 2 * (work or 0) <= float(graph.nodes.count()) * graph.edges.count() and (most or 0) <= LINKS


def _hubs(graph: Graph, cycles: DataFrame | None = None, degrees: DataFrame | None = None, top: list[int] | None = None) -> tuple[list[int], DataFrame] | None:
    """Up to ``HUBS`` nodes without which at most half the work is left, and (id, label) of the other nodes; None if none are found.

    They are tried as those of far more links than all others, and as those where links from one strong component (of more nodes than
    one) enter another. Then no other links lead from one such component to another, so what is left is told apart by components, not node by node.
    """
    degrees = _degrees(graph.edges) if degrees is None else degrees
    if hubs := _most_linked(degrees) if top is None else top:
        label = _without(graph, hubs)
        if _falls_apart(graph, degrees, hubs, label):
            return hubs, label
    cycles = strong(graph) if cycles is None else cycles
    over = graph.edges.join(cycles.select(F.col("id").alias("src"), F.col("label").alias("a")), "src").join(cycles.select(F.col("id").alias("dst"), F.col("label").alias("b")), "dst")
    over = cut(over.where("a <> b"), "over")
    large = cycles.groupBy("label").count().where("count > 1")
    entries = over.join(large.select(F.col("label").alias("a")), "a", "left_semi").join(large.select(F.col("label").alias("b")), "b", "left_semi")
    hubs = sorted(r["dst"] for r in entries.select("dst").distinct().limit(HUBS + 1).collect())
    if not 0 < len(hubs) <= HUBS:
        return None
    label = graph.nodes.where(~F.col("id").isin(hubs)).select("id").join(cycles, "id").select("id", "label")
    left = over.where(~F.col("src").isin(hubs) & ~F.col("dst").isin(hubs)).select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()
    if not (left := cut(left, "rest")).isEmpty():
        met = connected(Graph(left.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), left))
        label = label.join(met.select(F.col("id").alias("label"), F.col("label").alias("up")), "label", "left").select("id", F.coalesce("up", "label").alias("label"))
    label = cut(label, "labels")
    return (hubs, label) if _falls_apart(graph, degrees, hubs, label) else None


def search_through_hubs(graph: Graph, sources: DataFrame, below: int | None = None, summed: bool = False, cycles: DataFrame | None = None, known: tuple[list[int], DataFrame] | None = None, pooled: bool = False) -> DataFrame | None:
    """As ``search``, exact, for a graph that a few hubs hold together (see ``hubs``); None if it has none or has too many classes for it.

    ``known`` are its hubs and parts, as ``pieces`` has them.

    A part is searched by itself, with its sources' distances to the hubs given. The nodes of all parts are then counted by
    classes, of all sources' classes against all nodes', less what the part's own nodes count among them.
    """
    spark = graph.edges.sparkSession
    if (found := known or _hubs(graph, cycles)) is None:
        return None
    hubs, label = found
    ids, edges = np.array(hubs, np.int64), graph.edges
    in_hubs = lambda c: F.col(c).isin(hubs)
    own = sources.join(label, "id").select("label", F.col("id").alias("src"), F.lit(None).cast("long").alias("dst"))
    # A link goes with its end that is no hub.
    at = F.when(in_hubs("src"), F.col("dst")).otherwise(F.col("src"))
    linked = edges.where(~(in_hubs("src") & in_hubs("dst"))).withColumn("id", at).join(label, "id").select("label", "src", "dst")
    held = cut(own.unionByName(linked), "parts")
    comps = held.groupBy("label").agg(F.count("dst").alias("m"), F.count_if(F.col("dst").isNull()).alias("s"))
    small = F.col("m") + F.col("s") < SMALL
    parts = F.least(F.lit(PARTS), F.ceil(F.col("s") / (64 * WORDS)), 1 + F.floor(F.col("s").cast("double") * F.col("m") / (5 * SHARE)))
    comps = cut(comps.select("label", "m", "s", (~small).alias("large"), F.when(small, 1).otherwise(F.greatest(F.lit(1), parts)).cast("int").alias("parts")), "components")
    rest, large, all_parts = comps.agg(F.sum(F.when(small, F.col("m") + F.col("s"))), F.count_if("large"), F.sum(F.when(~small, F.col("parts")))).first()
    bins = max(1, -(-(rest or 0) // SMALL))
    comps = comps.select("label", "large", "parts", F.when(F.col("large"), F.col("label")).otherwise(F.pmod(F.xxhash64("label"), F.lit(bins))).alias("bin"))
    rows = held.join(F.broadcast(comps) if (large or 0) + bins < 1000 and comps.count() < 10_000 else comps, "label").select("large", "bin", "parts", "src", "dst")
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def dealt(df: DataFrame, keys: list[str], tasks: int) -> DataFrame:
        return df.repartition(max(least, min(2000, tasks)), *keys).sortWithinPartitions(*keys)

    def part(group: pa.Table) -> Part:
        link = group.column("dst").is_valid().to_numpy()
        src, dst = group.column("src").to_numpy(), group.column("dst").fill_null(0).to_numpy()
        return Part(src[link], dst[link], src[~link], ids)

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(a, b, d): distances hub x hub by way of a part; at a = -1 how many classes there are at most, at -2 the largest distance."""
        for group in groups(batches, ["large", "bin"]):
            p = part(group)
            ahead, back = p.near(False), p.near(True)[p.sources]
            d = p.between(ahead)
            a, b = np.nonzero(d < FAR)
            far = max((int(x[x < FAR].max(initial=0)) for x in (ahead, back)), default=0)
            more = np.array([[-1, 0, len(classes(ahead)[0])], [-1, 1, len(classes(back)[0])], [-2, 0, far]], np.int64)
            yield pa.record_batch([np.concatenate((x, more[:, k])) for k, x in enumerate((a, b, d[a, b].astype(np.int64)))], names=["a", "b", "d"])

    keys = ["large", "bin"]
    got = cut(dealt(rows, keys, bins + 2 * (large or 0)).mapInArrow(steps, "a long, b long, d long"), "between")
    got = got.groupBy("a", "b").agg(F.min("d").alias("least"), F.max("d").alias("most"), F.sum("d").alias("sum")).collect()
    between = np.full((len(ids), len(ids)), FAR, np.int32)
    for r in got:
        if r["a"] >= 0:
            between[r["a"], r["b"]] = r["least"]
    for r in edges.where(in_hubs("src") & in_hubs("dst")).collect():
        between[np.searchsorted(ids, r["src"]), np.searchsorted(ids, r["dst"])] = 1
    between = closed(between)
    far = max([r["most"] for r in got if r["a"] == -2], default=0) * 2 + int(between[between < FAR].max())
    far = min(far, below or far)
    some = {r["b"]: r["sum"] + len(ids) for r in got if r["a"] == -1}
    n, m = sources.count(), edges.count()
    if far > KINDS[-1][0] or float(some.get(0, 0)) * some.get(1, 0) * len(ids) > float(n) * m / WORTH:
        return None
    kind = next(k for k, (most, _, _) in enumerate(KINDS) if far <= most)
    words = WORDS

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, ["large", "bin", "part"]):
            yield from part_rows(part(group), between, kind, words, group.column("part")[0].as_py() == 0, below, summed, pooled)

    # Sources are dealt out to a part's tasks; its links go to each.
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    mine = F.when(F.col("dst").isNull(), F.array(F.pmod(F.xxhash64(F.floor(F.col("src") / 64)), F.col("parts")).cast("int"))).otherwise(every)
    shared = rows.select("large", "bin", F.explode(mine).alias("part"), "src", "dst")
    found = cut(dealt(shared, ["large", "bin", "part"], bins + 2 * (all_parts or 0)).mapInArrow(walk, "id long, class binary, n array<long>"), "found")
    free(held)
    to, since = packed(between, kind, below), packed(between.T.copy(), kind, below)
    asked = {r["id"] for r in sources.where(in_hubs("id")).collect()}
    of_hubs = spark.createDataFrame([(1 if pooled else h, bytearray(to[k].tobytes()), []) for k, h in enumerate(hubs) if h in asked] + [(None, bytearray(x.tobytes()), [1]) for x in since], "id long, class binary, n array<long>")
    found = found.unionByName(of_hubs)
    dtype, wide = KINDS[kind][1], len(ids)
    ends = cut(found.where("id is null").groupBy("class").agg(F.sum(F.col("n")[0]).alias("c")), "classes")
    begins = cut(found.where("id is not null").select("class").distinct(), "classes")

    def rows_of(df: DataFrame, name: str, *cols: str) -> DataFrame:
        chunks = max(1, -(-df.count() // CLASSES))
        held = df.groupBy(F.pmod(F.xxhash64("class"), F.lit(chunks))).agg(F.collect_list(F.struct(*cols)).alias("held"))
        return held.select(*[F.col("held")[c].alias(f"{name}_{c}") for c in cols])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                as_rows = lambda x: np.frombuffer(b"".join(x), dtype).reshape(-1, wide)
                counts = class_counts(as_rows(r["to_class"]), as_rows(r["since_class"]), np.array(r["since_c"], np.int64), kind, below)
                counts = sums(counts) if summed else counts
                row, dist = np.nonzero(counts)
                blobs = pa.array(r["to_class"], pa.binary())
                yield pa.record_batch([blobs.take(pa.array(row)), pa.array(dist.astype(np.int32)), pa.array(counts[row, dist])], names=["class", "dist", "c"])

    pairs = rows_of(begins, "to", "class").crossJoin(rows_of(ends.select("class", "c"), "since", "class", "c")).select("to_class", "since_class", "since_c")
    total = pairs.repartition(least).mapInArrow(count, "class binary, dist int, c long").groupBy("class", "dist").agg(F.sum("c").alias("c"))
    total = total.groupBy("class").agg(F.map_from_entries(F.collect_list(F.struct("dist", "c"))).alias("m"))
    total = cut(total.select("class", F.transform(F.sequence(F.lit(0), F.array_max(F.map_keys("m"))), lambda d: F.coalesce(F.col("m")[d], F.lit(0))).alias("c")), "totals")
    # A class from which no hub is reached has no totals.
    times = F.col("id") if pooled else F.lit(1)
    added = F.zip_with(F.coalesce("c", F.array().cast("array<long>")), "n", lambda a, b: times * F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
    both = found.where("id is not null").join(total, "class", "left").select(F.col("id").alias("source"), added.alias("n"))
    if summed:
        at = lambda k: F.coalesce(F.get("n", F.lit(k)), F.lit(0).cast("long"))
        return both.select("source", at(0).alias("reachable"), at(1).alias("distances"))
    out = both.select("source", F.posexplode("n").alias("dist", "n")).where("n > 0")
    return out.drop("source") if pooled else out


def search_by_joins(graph: Graph, sources: DataFrame, below: int | None = None) -> DataFrame:
    """As ``search``, for graphs of any size: a round is a job, and its rows are written to the shared folder.

    The sources are numbered and travel as bits: a row holds, for one node and one block of ``WORDS`` * 64
    sources, which of them have reached the node and which did so in the last round. A round is one join with
    the links and one aggregation; pairs of source and node are never rows. Repeated sources count once, null ones
    not at all; no sources give no rows.
    """
    span = 64 * WORDS
    numbered = cut(dense_ids(sources.select("id").where("id is not null").distinct(), "id", "k").select("id", (F.col("k") - 1).alias("k")), "sources")
    edges = cut(graph.edges.select("src", "dst").distinct(), "steps")
    at = F.pmod("k", F.lit(span))
    own = [F.when(F.floor(at / 64) == w, F.expr("shiftleft(1L, cast(k % 64 as int))")).otherwise(F.lit(0).cast("long")) for w in range(WORDS)]
    seen, fresh = [f"s{w}" for w in range(WORDS)], [f"f{w}" for w in range(WORDS)]
    none = lambda names: [F.lit(0).cast("long").alias(c) for c in names]
    state = numbered.select(F.col("id").alias("node"), F.floor(F.col("k") / span).alias("block"), *[b.alias(c) for names in (seen, fresh) for b, c in zip(own, names)])
    state, levels = cut(state, "reached"), []
    anew = " or ".join(f"{c} <> 0" for c in fresh)
    while True:
        words = state.where(anew).select("block", F.posexplode(F.array(*fresh)).alias("word", "bits")).where("bits <> 0")
        per_source = F.array(*[F.sum(F.getbit("bits", F.lit(i)).cast("long")) for i in range(64)])
        level = cut(words.groupBy("block", "word").agg(per_source.alias("n")).withColumn("dist", F.lit(len(levels))), "level")
        levels.append(level)
        if level.isEmpty() or len(levels) == below:
            break
        met = state.where(anew).select(F.col("node").alias("src"), "block", *fresh).join(edges, "src").select(F.col("dst").alias("node"), "block", *none(seen), *fresh)
        both = state.select("node", "block", *seen, *none(fresh)).unionByName(met).groupBy("node", "block").agg(*[F.bit_or(c).alias(c) for c in seen + fresh])
        joined = [F.col(s).bitwiseOR(F.col(f)).alias(s) for s, f in zip(seen, fresh)] + [F.col(f).bitwiseAND(F.bitwise_not(F.col(s))).alias(f) for s, f in zip(seen, fresh)]
        after = cut(both.select("node", "block", *joined), "reached")
        free(state)
        state = after
    free(state)
    free(edges)
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    out = out.select("dist", "block", "word", F.posexplode("n").alias("bit", "n")).where("n > 0")
    out = out.select("dist", "n", (F.col("block") * span + F.col("word") * 64 + F.col("bit")).alias("k"))
    return out.join(numbered, "k").select(F.col("id").alias("source"), "dist", "n")


def histograms(reached: DataFrame) -> DataFrame:
    """(source, dist, n): how many nodes each source first reaches at each distance."""
    return reached.groupBy("source", "dist").agg(F.count("*").alias("n"))


def count_arrays(reached: DataFrame) -> DataFrame:
    """(source, count_dist): the histogram as an array indexed by distance; of pairs (source, node, dist) or of histograms."""
    h = reached if "n" in reached.columns else histograms(reached)
    h = h.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("dist", "n"))).alias("h"))
    return h.select("source", F.transform("h", lambda x: x["n"]).alias("count_dist"))


def connected(graph: Graph) -> DataFrame:
    """(id, label): the smallest id in each node's component, directions ignored.

    First, blocks of near ids contract the links within them in memory, if a block has at most ``GATHER`` of them. Tasks then thin
    out the other links to forests of the same components. Up to ``GATHER`` links that are left meet in one task; while there are more,
    they are contracted under a rank that changes with each round: nodes join their least neighbour, edges are
    relabelled, loops and repeats dropped. Labels are resolved backwards.
    """
    pairs = graph.edges.where("src <> dst").select(F.least("src", "dst").cast("long").alias("u"), F.greatest("src", "dst").cast("long").alias("v"))
    m, least, most = pairs.agg(F.count("*"), F.min("u"), F.max("v")).first()
    parts = -(-m // max(1, GATHER // 2)) if m > GATHER else 1
    block = lambda c: _block(c, parts, least or 0, most or 0)
    blocks = pairs.select(block("u").alias("block"), block("v").alias("_to"), "u", "v")
    full = F.lit(False)
    if parts > 1:  # an uneven block is left to the rounds
        many = [r["block"] for r in blocks.where("block = _to").groupBy("block").count().where(F.col("count") > GATHER).collect()]
        full = F.col("block").isin(many) if many else full
    within = blocks.where((F.col("block") == F.col("_to")) & ~full).drop("_to").repartitionById(parts, "block").sortWithinPartitions("block")
    first = cut(within.mapInArrow(_joined_block, "id long, up long"), "parents")
    rest = blocks.where((F.col("block") != F.col("_to")) | full).select("u", "v")
    if parts > 1 and not first.isEmpty():
        up = [first.select(F.col("id").alias(c), F.col("up").alias(f"p{c}")) for c in ("u", "v")]
        rest = rest.join(up[0], "u", "left").join(up[1], "v", "left").select(F.coalesce("pu", "u").alias("pu"), F.coalesce("pv", "v").alias("pv")).where("pu <> pv")
        rest = rest.select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v"))
    if parts > 1:  # by both ends, so that a node of very many links is dealt to several tasks
        rest = rest.repartitionByRange(2 * parts, "u", "v").mapInArrow(_forest, "u long, v long")
    edge = cut(rest, "pairs")
    maps: list[DataFrame] = [first]
    while (m := edge.count()) > GATHER:
        turn = F.lit(len(maps))
        rank = lambda c, t=turn: F.struct(F.xxhash64(t, c).alias("h"), F.col(c).alias("id"))
        both = edge.select(F.col("u").alias("id"), rank("v").alias("r")).unionByName(edge.select(F.col("v").alias("id"), rank("u").alias("r")))
        step = both.groupBy("id").agg(F.min("r").alias("r"))
        step = cut(step.select("id", F.least("r", rank("id"))["id"].alias("up")), "parents")
        maps.append(step)
        moved = edge.join(step.select(F.col("id").alias("u"), F.col("up").alias("pu")), "u").join(step.select(F.col("id").alias("v"), F.col("up").alias("pv")), "v").where("pu <> pv")
        after = cut(moved.select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct(), "pairs")
        free(edge)
        edge = after
    if m:
        maps.append(cut(edge.repartition(1).mapInArrow(_forest, "u long, v long").select(F.col("v").alias("id"), F.col("u").alias("up")), "parents"))
    label = graph.nodes.select("id", F.col("id").alias("root"))
    for step in maps:
        label = label.join(step.select(F.col("id").alias("root"), "up"), "root", "left").select("id", F.coalesce("up", "root").alias("root"))
    label = cut(label, "labels")
    for step in [*maps, edge]:
        free(step)
    return label.join(label.groupBy("root").agg(F.min("id").alias("label")), "root").select("id", "label")


def _trim(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Take off nodes without an edge in or without one out, again and again: each is a component."""
    alone: list[DataFrame] = []
    while True:
        ends = edges.select(F.col("src").alias("id")).distinct().join(edges.select(F.col("dst").alias("id")).distinct(), "id")
        off = cut(nodes.join(ends, "id", "left_anti"), "trimmed")
        if off.isEmpty():
            return nodes, edges, alone
        alone.append(off)
        nodes = cut(nodes.join(ends, "id", "left_semi"), "rest")
        edges = cut(edges.join(nodes.withColumnRenamed("id", "src"), "src", "left_semi").join(nodes.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst"), "rest")


def _block(c: str, parts: int, least: int, most: int) -> Column:
    """Which of so many blocks of near ids has the id ``c``, between the least and the most."""
    return F.least(F.floor((F.col(c).cast("double") - least) * parts / (float(most) - least + 1)), F.lit(parts - 1)).cast("int")


def _joined_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for group in groups(batches, ["block"]):
        ids, least = joined_up(group.column("u").to_numpy(), group.column("v").to_numpy())
        moved = ids != least
        yield pa.record_batch([ids[moved], least[moved]], names=["id", "up"])


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's links (u, v) a forest with the same components: every end but the least of its component as v, and that one as u."""
    u = v = np.zeros(0, np.int64)
    held: list[pa.RecordBatch] = []

    def thinned() -> tuple[np.ndarray, np.ndarray]:
        ids, least = joined_up(*(np.concatenate((x, *(b.column(k).to_numpy() for b in held))) for k, x in enumerate((u, v))))
        moved = ids != least
        return least[moved], ids[moved]

    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) > GATHER // 2:
            u, v = thinned()
            held = []
    yield pa.record_batch([*thinned()], names=["u", "v"])


def _in_last_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, up, joined): of all links that are left, each end's strong component and its plain one."""
    for group in groups(batches, ["block"]):
        src, dst = group.column("src").to_numpy(), group.column("dst").to_numpy()
        (ids, least), (_, joined) = components(src, dst), joined_up(src, dst)
        yield pa.record_batch([ids, least, joined], names=["id", "up", "joined"])


def _in_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for group in groups(batches, ["block"]):
        src, dst = group.column("src").to_numpy(), group.column("dst").to_numpy()
        ids, least = components(src, dst)
        moved = ids != least
        left = np.unique(np.stack([least[np.searchsorted(ids, x)] for x in (src, dst)], axis=1), axis=0)
        left = left[left[:, 0] != left[:, 1]]
        yield pa.record_batch([np.concatenate((ids[moved], left[:, 0])), np.concatenate((least[moved], left[:, 1])), np.arange(moved.sum() + len(left)) >= moved.sum()], names=["id", "up", "link"])


def strong(graph: Graph) -> DataFrame:
    """(id, label): strongly connected components, labelled by their smallest id; see ``strong_and_joined``."""
    return strong_and_joined(graph).select("id", "label")


def strong_and_joined(graph: Graph) -> DataFrame:
    """(id, label, joined): the smallest id of each node's strong component and of its plain one, the results of ``strong`` and ``connected``.

    Blocks of near ids find the strong components of the links within them in memory and contract them, and so do what is left
    in ever larger blocks, until all of it is one block, which also joins what is left. Links that no longer shrink so, ``GATHER`` of them or
    more, are left to ``strong_by_colours`` and ``connected``.
    """
    edges = cut(graph.inner().edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).where("src <> dst").distinct(), "rest") if not isinstance(graph, Steps) else graph.edges
    maps: list[DataFrame] = []
    written: list[DataFrame] = []
    before = size = BLOCK
    while True:
        m, least, most = edges.agg(F.count("*"), F.min(F.least("src", "dst")), F.max(F.greatest("src", "dst"))).first()
        if not m:
            break
        if m > GATHER and maps and 2 * m > before:
            break
        before, parts = m, 1 if m <= GATHER else -(-m // size)
        size = max(BLOCK, min(2 * size, GATHER))
        blocks = edges.select(_block("src", parts, least, most).alias("block"), _block("dst", parts, least, most).alias("_to"), "src", "dst")
        waits = F.col("block") != F.col("_to")
        if parts > 1:  # an uneven block waits until its links are fewer
            many = [r["block"] for r in blocks.where(~waits).groupBy("block").count().where(F.col("count") > GATHER).collect()]
            waits = waits | F.col("block").isin(many) if many else waits
        within = blocks.where(~waits).drop("_to").repartitionById(parts, "block").sortWithinPartitions("block")
        if parts == 1:
            written.append(cut(within.mapInArrow(_in_last_block, "id long, up long, joined long"), "parents"))
            break
        # What a block found: its components, and the links that are left between them.
        met = cut(within.mapInArrow(_in_block, "id long, up long, link boolean"), "parents")
        written.append(met)
        step = met.where("not link").select("id", "up")
        maps.append(step)
        ends = [step.select(F.col("id").alias(c), F.col("up").alias(f"{c}_up")) for c in ("src", "dst")]
        moved = blocks.where(waits).join(ends[0], "src", "left").join(ends[1], "dst", "left").select(F.coalesce("src_up", "src").alias("src"), F.coalesce("dst_up", "dst").alias("dst"))
        moved = moved.unionByName(met.where("link").select(F.col("id").alias("src"), F.col("up").alias("dst")))
        after = cut(moved.where("src <> dst").distinct(), "rest")
        if edges is not graph.edges:
            free(edges)
        edges = after
    label = graph.nodes.select(F.col("id").cast("long").alias("id"), F.col("id").cast("long").alias("root"))
    for step in maps:
        label = label.join(step.select(F.col("id").alias("root"), "up"), "root", "left").select("id", F.coalesce("up", "root").alias("root"))
    last = bool(m) and parts == 1
    if last:
        label = label.join(written[-1].select(F.col("id").alias("root"), "up", "joined"), "root", "left").select("id", F.coalesce("up", "root").alias("label"), F.coalesce("joined", "root").alias("joined"))
    label = cut(label, "labels")
    for met in written:
        free(met)
    if last or not m:
        if edges is not graph.edges:
            free(edges)
        return label if last else label.select("id", F.col("root").alias("label"), F.col("root").alias("joined"))
    left = Graph(label.select(F.col("root").alias("id")).distinct(), edges)
    both = strong_by_colours(left).join(connected(left).select("id", F.col("label").alias("joined")), "id")
    return label.join(both.withColumnRenamed("id", "root"), "root").select("id", "label", "joined")


def strong_by_colours(graph: Graph) -> DataFrame:
    """As ``strong``, for graphs of any size and shape, each step a job.

    Each round trims what cannot be in a cycle, gives every node the least id that reaches it (its
    colour), and walks back from each colour's root within the colour: what it meets is one component.
    """
    nodes = graph.nodes
    edges = cut(graph.inner().edges.where("src <> dst").distinct(), "rest")
    done: list[DataFrame] = []
    while True:
        nodes, edges, alone = _trim(nodes, edges)
        done += [a.select("id", F.col("id").alias("root")) for a in alone]
        if nodes.isEmpty():
            break
        colour = cut(nodes.select("id", F.col("id").alias("c")), "colours")
        while True:
            best = edges.join(colour.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("c").alias("m"))
            step = cut(colour.join(best, "id", "left").select("id", F.least("c", F.coalesce("m", "c")).alias("c"), (F.coalesce("m", "c") < F.col("c")).alias("moved")), "colours")
            still = step.where("moved").isEmpty()
            free(colour)
            colour = step
            if still:
                break
        colour = colour.select("id", "c")
        inside = edges.join(colour.select(F.col("id").alias("src"), F.col("c").alias("a")), "src").join(colour.select(F.col("id").alias("dst"), F.col("c").alias("b")), "dst").where("a = b")
        inside = cut(inside.select("src", "dst", F.col("a").alias("c")), "inside")
        met = front = cut(colour.where("id = c"), "met")
        while True:
            back = front.select(F.col("id").alias("dst"), "c").join(inside, ["dst", "c"]).select(F.col("src").alias("id"), "c").distinct()
            front = cut(back.join(met.select("id"), "id", "left_anti").select("id", "c"), "met")
            if front.isEmpty():
                break
            met = cut(met.unionByName(front), "met")
        done.append(met.select("id", F.col("c").alias("root")))
        nodes = cut(nodes.join(met.select("id"), "id", "left_anti"), "rest")
        edges = cut(edges.join(nodes.withColumnRenamed("id", "src"), "src", "left_semi").join(nodes.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst"), "rest")
    out = graph.nodes.sparkSession.createDataFrame([], "id long, root long")
    for part in done:
        out = out.unionByName(part)
    return out.withColumnRenamed("root", "label")


def sizes(labels: DataFrame) -> DataFrame:
    """(size, count): run lengths of component sizes, ascending when sorted by size."""
    return labels.groupBy("label").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("count"))


def pagerank(graph: Graph, damping: float = DAMPING, tolerance: float = TOLERANCE, most: int = 1000) -> tuple[DataFrame, int]:
    """(id, rank), normalised to sum 1, and the number of steps.

    The mass of nodes without outgoing edges is lost at each step, parallel edges count, and iteration
    ends when the summed change is under ``tolerance``; only the result is normalised.
    """
    inner = graph.inner().edges
    out = inner.groupBy("src").agg(F.count("*").alias("o"))
    weights = cut(inner.groupBy("src", "dst").agg(F.count("*").alias("k")).join(out, "src").select("src", "dst", (F.col("k") / F.col("o")).alias("w")), "weights")
    n = graph.nodes.count()
    if not n:
        return graph.nodes.select("id", F.lit(0.0).alias("rank")), 0
    rank = cut(graph.nodes.select("id", F.lit(1.0 / n).alias("rank")), "ranks")
    for step in range(1, most + 1):
        given = weights.join(rank.select(F.col("id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("w")).alias("g"))
        after = cut(rank.join(given, "id", "left").select("id", (F.lit((1 - damping) / n) + damping * F.coalesce("g", F.lit(0.0))).alias("rank"), F.col("rank").alias("before")), "ranks")
        delta, total = after.agg(F.sum(F.abs(F.col("rank") - F.col("before"))), F.sum("rank")).first()
        free(rank)
        rank = after
        if delta < tolerance:
            break
    free(weights)
    return rank.select("id", (F.col("rank") / F.lit(total)).alias("rank")), step
