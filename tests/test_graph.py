"""Graph operators on small graphs with known answers."""

import random

import pytest

from linkatlas.functions import metrics
from linkatlas.functions.formats import counted, pairs_json, permutation, stride
from linkatlas.operators import traversal
from linkatlas.operators.graph import Graph
from linkatlas.sources.store import adjacency_text, read_graph, write_graph
from pyspark.sql import functions as F


def graph(spark, n, edges):
    return Graph(spark.range(1, n + 1), spark.createDataFrame(edges, "src long, dst long"))


THREE = [(2, 1), (2, 3), (3, 1)]


def as_dict(df, k, v):
    return {r[k]: r[v] for r in df.collect()}


def test_three_nodes(spark):
    g = graph(spark, 3, THREE)
    assert as_dict(traversal.count_arrays(traversal.distances(g, g.nodes)), "source", "count_dist") == {1: [1], 2: [1, 2], 3: [1, 1]}
    assert as_dict(traversal.sizes(traversal.strong(g)), "size", "count") == {1: 3}
    ranks, steps = traversal.pagerank(g)
    assert steps == 4
    assert {k: round(v, 6) for k, v in as_dict(ranks, "id", "rank").items()} == {1: 0.520869, 3: 0.281551, 2: 0.19758}
    assert {r.value for r in adjacency_text(g).collect()} == {"2: 1 3", "3: 1"}
    assert {(r.id, r.in_degree, r.out_degree) for r in g.degrees().collect()} == {(1, 2, 0), (2, 0, 2), (3, 1, 1)}


def test_transpose_and_add(spark):
    g = graph(spark, 3, THREE)
    assert {(r.src, r.dst) for r in g.transpose(2, 3).edges.collect()} == {(3, 2)}
    assert sorted((r.src, r.dst) for r in g.transpose(1, 1).edges.collect()) == [(1, 2), (1, 3)]
    double = g.add(g)
    assert as_dict(double.adjacency(), "id", "neighbors") == {2: [1, 1, 3, 3], 3: [1, 1]}
    assert double.size().first().asDict() == {"num_nodes": 3, "num_edges": 6, "stray_edges": 0}
    assert sorted(map(tuple, g.transpose().transpose().edges.collect())) == sorted(THREE)


def test_stray_and_masked_edges(spark):
    g = Graph(spark.range(1, 3), spark.createDataFrame([(1, 2), (1, 9), (9, 1)], "src long, dst long"))
    assert g.size().first().stray_edges == 1
    assert [tuple(r) for r in g.inner().edges.collect()] == [(1, 2)]


def brute_strong(n, edges):
    reach = {i: {i} for i in range(1, n + 1)}
    for _ in range(n):
        for a, b in edges:
            reach[a] |= reach[b]
    return {i: min(j for j in reach[i] if i in reach[j]) for i in reach}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_of_chained_cycles(spark, seed):
    rng = random.Random(seed)
    n, edges = 40, []
    for a, b in ((1, 6), (7, 7), (8, 15), (16, 18), (19, 25)):
        edges += [(i, i + 1) for i in range(a, b)] + ([(b, a)] if b > a else [])
    edges += [(6, 8), (3, 16), (18, 19), (25, 30), (30, 31), (31, 31)] + [(rng.randint(26, 40), rng.randint(26, 40)) for _ in range(12)]
    order = list(range(1, n + 1))
    rng.shuffle(order)
    edges = [(order[a - 1], order[b - 1]) for a, b in edges]
    g = graph(spark, n, edges)
    assert as_dict(traversal.strong(g), "id", "label") == brute_strong(n, edges)
    both = edges + [(b, a) for a, b in edges]
    assert as_dict(traversal.connected(g), "id", "label") == brute_strong(n, both)


def test_empty_and_isolated(spark):
    g = graph(spark, 3, [])
    assert as_dict(traversal.sizes(traversal.strong(g)), "size", "count") == {1: 3}
    assert as_dict(traversal.connected(g), "id", "label") == {1: 1, 2: 2, 3: 3}
    assert as_dict(traversal.count_arrays(traversal.distances(g, g.nodes)), "source", "count_dist") == {1: [1], 2: [1], 3: [1]}
    nobody = Graph(spark.range(0), g.edges)
    assert traversal.pagerank(nobody)[0].count() == 0


def test_long_chain(spark):
    g = graph(spark, 24, [(i, i + 1) for i in range(1, 24)])
    assert as_dict(traversal.count_arrays(traversal.distances(g, spark.range(1, 2))), "source", "count_dist") == {1: [1] * 24}


def test_closeness_with_single_components(spark):
    g = graph(spark, 3, THREE)
    near = metrics.closeness(traversal.distances(g, g.nodes))
    top = metrics.most_central(near, 1)
    assert [(r.source, r.closeness) for r in top.collect()] == [(1, 0.0), (2, 1.0), (3, 1.0)]
    with pytest.raises(ValueError):
        metrics.most_central(near, 0)


def test_permutation_is_a_bijection(spark):
    for n in range(1, 101):
        s = stride(n, 42)
        assert sorted(((i - 1) * s) % n + 1 for i in range(1, n + 1)) == list(range(1, n + 1))
    assert sorted(r.k for r in permutation(spark, 30, 42, 30).collect()) == list(range(1, 31))


def test_counts_and_json(spark):
    v = spark.createDataFrame([(x,) for x in (1, 2, 3, 4, 1, 3)], "v long")
    c = counted(v, "v")
    assert as_dict(c, "value", "count") == {1: 2, 2: 1, 3: 2, 4: 1}
    assert c.agg(pairs_json(F.col("value"), F.col("count")).alias("j")).first().j == "[[1,2],[2,1],[3,2],[4,1]]"


def test_store(spark, tmp_path):
    g = graph(spark, 4, THREE)
    write_graph(g, f"file://{tmp_path}/g")
    back = read_graph(spark, f"file://{tmp_path}/g")
    assert back.nodes.count() == 4
    assert sorted(map(tuple, back.edges.collect())) == sorted(THREE)


def test_search_by_bits(spark):
    """More sources than one row carries, against a plain search; repeated and null sources, self and parallel links."""
    from collections import Counter, deque

    rng = random.Random(7)
    n = 64 * traversal.WORDS + 90
    edges = [(rng.randint(1, n), rng.randint(1, n)) for _ in range(n)] + [(1, 1), (2, 3), (2, 3)]
    g = Graph(spark.range(1, n + 1), spark.createDataFrame(edges, "src long, dst long"))
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    want = {}
    for s in range(1, n + 1):
        dist, todo = {s: 0}, deque([s])
        while todo:
            u = todo.popleft()
            for v in after.get(u, ()):
                if v not in dist:
                    dist[v] = dist[u] + 1
                    todo.append(v)
        want |= {(s, d): k for d, k in Counter(dist.values()).items()}
    sources = spark.createDataFrame([(i,) for i in [*range(1, n + 1), 5, None]], "id long")
    assert {(r.source, r.dist): r.n for r in traversal.search(g, sources).collect()} == want
    assert traversal.search(g, sources.limit(0)).count() == 0


def _components_to_search(n=130):
    """A dense component, chains in and out of it, a hub of more links than a slice's row, pairs and lone nodes."""
    rng = random.Random(3)
    edges = [(rng.randint(1, 80), rng.randint(1, 80)) for _ in range(300)] + [(i, i + 1) for i in range(80, 100)] + [(i, 80) for i in range(1, 81)]
    return n, edges + [(110, 111), (111, 110), (112, 113)]


@pytest.mark.parametrize("limits", [{}, {"SMALL": 1, "SHARE": 50, "WORDS": 1}, {"SMALL": 1, "LINKS": 50}])
def test_search_writes_no_rounds(spark, monkeypatch, limits):
    n, edges = _components_to_search()
    g = graph(spark, n, edges)
    want = {(r.source, r.dist): r.n for r in traversal.histograms(traversal.distances(g, g.nodes)).collect()}
    written = []
    plain = traversal.cut
    monkeypatch.setattr(traversal, "cut", lambda df, name="step": written.append(name) or plain(df, name))
    for name, value in limits.items():
        monkeypatch.setattr(traversal, name, value)
    assert {(r.source, r.dist): r.n for r in traversal.search(g, g.nodes).collect()} == want
    assert "LINKS" in limits or not {"reached", "level"} & {*written}


@pytest.mark.parametrize("limits", [{}, {"GATHER": 12, "BLOCK": 6}, {"GATHER": 0, "BLOCK": 5}])
def test_strong_of_a_chain_of_cycles(spark, monkeypatch, limits):
    """Cycles that lead from one into the next, which took rounds for each pair of them; the jobs are counted."""
    for name, value in limits.items():
        monkeypatch.setattr(traversal, name, value)
    n = 24
    edges = [(i, i - 2 if i % 3 == 0 else i + 1) for i in range(1, n + 1)] + [(i, i + 1) for i in range(3, n, 3)] + [(7, 7), (1, 2), (1, 99)]
    written = []
    plain = traversal.cut
    monkeypatch.setattr(traversal, "cut", lambda df, name="step": written.append(name) or plain(df, name))
    got = as_dict(traversal.strong(graph(spark, n, edges)), "id", "label")
    assert got == {i: i - (i - 1) % 3 for i in range(1, n + 1)}
    assert limits or len(written) < 5


@pytest.mark.parametrize("shape", ["both ways", "chain"])
@pytest.mark.parametrize("limits", [{}, {"SMALL": 1, "SHARE": 50, "WORDS": 1, "CLASSES": 3}])
def test_search_through_hubs(spark, monkeypatch, shape, limits):
    """Parts that hold together by a few nodes of many links, or by one link from each to the next, against the plain search."""
    rng = random.Random(5)
    n, edges = 150, []
    for c in range(5):
        ids = range(c * 30 + 1, c * 30 + 31)
        edges += [(ids[i], ids[(i + 1) % 30]) for i in range(30)] + [(rng.choice(ids), rng.choice(ids)) for _ in range(20)]
        if shape == "chain":
            edges += [(rng.choice(ids), ids[-1] + 1)] if c < 4 else []
        else:
            edges += [(i, 151 + rng.randrange(2)) for i in ids] + [(153, 151), (153, 154)]
    if shape == "both ways":
        n, edges = 154, edges + [(b, a) for a, b in edges]
    g = graph(spark, n, edges)
    want = {(r.source, r.dist): r.n for r in traversal.histograms(traversal.distances(g, g.nodes)).collect()}
    asked = []
    plain = traversal.search_through_hubs
    monkeypatch.setattr(traversal, "search_through_hubs", lambda *a: asked.append(plain(*a)) or asked[-1])
    monkeypatch.setattr(traversal, "WIDE", 10)
    monkeypatch.setattr(traversal, "WORTH", 1e-3)
    for name, value in limits.items():
        monkeypatch.setattr(traversal, name, value)
    assert {(r.source, r.dist): r.n for r in traversal.search(g, g.nodes).collect()} == want
    assert asked[0] is not None


@pytest.mark.parametrize("limits", [{"SMALL": 1, "WORDS": 1}, {"SMALL": 1, "LINKS": 30}, {"WIDE": 10, "WORTH": 1e-3}])
def test_search_below_and_summed(spark, monkeypatch, limits):
    """Cycles in a chain, and a tail from which no cycle is reached: histograms under a distance, and sums."""
    from collections import Counter

    n, edges = 75, [(i, i + 1) for i in range(65, 70)] + [(3, 65), (72, 73)]
    edges += [(i, i - 14 if i % 15 == 0 else i + 1) for i in range(1, 61)] + [(15, 16), (30, 31), (45, 46)] + [(i, 16 + 7 * i % 13) for i in range(16, 31)]
    dist = {(i, i): 0 for i in range(1, n + 1)}
    for _ in range(n):
        for a, b in edges:
            for s in range(1, n + 1):
                if (s, a) in dist:
                    dist[s, b] = min(dist.get((s, b), n), dist[s, a] + 1)
    want = Counter((s, d) for (s, _), d in dist.items())
    for name, value in limits.items():
        monkeypatch.setattr(traversal, name, value)
    g = graph(spark, n, edges)
    for below in (4,) if "LINKS" in limits else (None, 4):
        got = [((r.source, r.dist), r.n) for r in traversal.search(g, g.nodes, below).collect()]
        assert len(got) == len(dict(got))
        assert dict(got) == {k: v for k, v in want.items() if below is None or k[1] < below}
    if "LINKS" in limits:
        return
    near = [tuple(r) for r in traversal.search(g, g.nodes, summed=True).select("source", "reachable", "distances").collect()]
    assert sorted(near) == [(s, sum(v for (a, d), v in want.items() if a == s and d), sum(d * v for (a, d), v in want.items() if a == s)) for s in range(1, n + 1)]


@pytest.mark.parametrize("most", [traversal.GATHER, 12, 0])
def test_connected_in_blocks(spark, monkeypatch, most):
    """Pairs of near ids are contracted in memory, so that a single block needs no round; others cross blocks or are too many for one."""
    edges = [(i, i + 1) for i in range(1, 12)] + [(20, 13), (14, 20), (5, 5), (30, 22), (22, 30), (25, 13)] + [(40, i) for i in range(41, 47)]
    written = []
    plain = traversal.cut
    monkeypatch.setattr(traversal, "cut", lambda df, name="step": written.append(name) or plain(df, name))
    monkeypatch.setattr(traversal, "GATHER", most)
    both = edges + [(b, a) for a, b in edges]
    assert as_dict(traversal.connected(graph(spark, 46, edges)), "id", "label") == brute_strong(46, both)
    assert most < 20 or written.count("pairs") == 1


def test_connected_gathers_what_is_left(spark, monkeypatch):
    """Links between far ids are thinned out to forests by the tasks, and what is left meets in one task: no round is written."""
    edges = [(i, 41 + i % 2) for i in range(1, 39)] + [(38, 40), (41, 3)]
    both = edges + [(b, a) for a, b in edges]
    written = []
    plain = traversal.cut
    monkeypatch.setattr(traversal, "cut", lambda df, name="step": written.append(name) or plain(df, name))
    monkeypatch.setattr(traversal, "GATHER", 60)
    assert as_dict(traversal.connected(graph(spark, 42, both)), "id", "label") == brute_strong(42, both)
    assert written.count("pairs") == 1


def test_search_takes_known_components(spark, monkeypatch):
    """Components that are known are not looked for again."""
    edges = [(i, i % 15 + 1) for i in range(1, 16)] + [(i, 16 + (i - 15) % 15) for i in range(16, 31)] + [(15, 16)]
    g = graph(spark, 31, edges)
    joined, cycles = traversal.connected(g), traversal.strong(g)
    asked = []
    monkeypatch.setattr(traversal, "strong", lambda *a: asked.append(a))
    monkeypatch.setattr(traversal, "WIDE", 10)
    got = traversal.search(g, g.nodes, summed=True, joined=joined, cycles=cycles)
    # 1 goes through 14 of its own cycle, and over 15 into all 15 nodes of the next.
    assert {r.source: (r.reachable, r.distances) for r in got.collect() if r.source in (1, 16, 31)} == {1: (29, 105 + sum(range(15, 30))), 16: (14, 105), 31: (0, 0)}
    assert not asked


@pytest.mark.parametrize("shape", ["chain", "hubs"])
@pytest.mark.parametrize("limits", [{}, {"WIDE": 10, "WORTH": 1e-3}, {"WIDE": 10, "WORTH": 1e-3, "GATHER": 20, "BLOCK": 9}])
def test_search_of_pieces(spark, monkeypatch, shape, limits):
    """Cycles in a chain with nodes between them, or parts that share two hubs: components once, and the search's histograms, sums and spectrum."""
    from collections import Counter

    n, edges = 48, [(i, i - 9 if i % 10 == 0 else i + 1) for i in range(1, 41)]
    edges += [(10, 11), (20, 42), (42, 21), (30, 31), (35, 43), (44, 3)] if shape == "chain" else [(i, 41 + i % 2) for i in range(1, 41)] + [(45, 46)]
    edges = sorted(set(edges) | (set() if shape == "chain" else {(b, a) for a, b in edges}))
    g = graph(spark, n, edges)
    half = None if shape == "chain" else g.edges.where("src < dst")
    g = traversal.Steps(g.nodes, traversal.cut(g.edges.selectExpr("cast(src as long) src", "cast(dst as long) dst")), half)
    want = {(r.source, r.dist): r.n for r in traversal.histograms(traversal.distances(g, g.nodes)).collect()}
    for name, value in limits.items():
        monkeypatch.setattr(traversal, name, value)
    asked = []
    plain = traversal.connected
    monkeypatch.setattr(traversal, "connected", lambda x: asked.append(x.nodes.count()) or plain(x))
    known = traversal.pieces(g, cycles=shape == "chain")
    assert as_dict(known.joined, "id", "label") == brute_strong(n, edges + [(b, a) for a, b in edges])
    assert shape == "hubs" or as_dict(known.cycles, "id", "label") == brute_strong(n, edges)
    # No component of the whole is looked for by itself: the chain has few links between cycles, the parts are without hubs.
    assert all(x < n for x in asked) or shape == "hubs" and not limits or shape == "chain" and "GATHER" in limits
    assert (known.hubs is None) == (not limits)
    assert {(r.source, r.dist): r.n for r in traversal.search(g, g.nodes, known=known).collect()} == want
    for below in (None, 3):
        spectrum = Counter()
        for (_, d), v in want.items():
            spectrum[d] += v if below is None or d < below else 0
        assert as_dict(metrics.spectrum(traversal.search(g, g.nodes, below, known=known, pooled=True)), "dist", "n") == {d: v for d, v in spectrum.items() if v}
    near = sorted(tuple(r) for r in traversal.search(g, g.nodes, summed=True, known=known).select("source", "reachable", "distances").collect())
    assert near == [(s, sum(v for (a, d), v in want.items() if a == s and d), sum(d * v for (a, d), v in want.items() if a == s)) for s in range(1, n + 1)]
