"""Dump files and the load, with answers worked out by hand."""

import gzip

import pytest
from pyspark.sql import functions as F

from linkatlas.operators import traversal
from linkatlas.plans import report
from linkatlas.plans.build import Wiki
from linkatlas.plans.commands import Jobs
from linkatlas.sources.dump import read_dump, read_wiki, resolve, tuples
from linkatlas.streaming.jobs import serve

#: A small wiki whose graph and results were worked out by hand; the test is end to end, so it needs the whole of it.
PAGES = [(1, 0, "Main_Page", 0), *[(i, 0, f"P{i - 1}", 0) for i in range(2, 6)], *[(i, 0, f"MESH{i - 5}", 0) for i in range(6, 13)], (13, 14, "Pages_with_P_prefix", 0), (14, 14, "Main_category", 0), (15, 0, "REDIR1", 1), (16, 0, "REDIR2", 1), (17, 0, "REDIR3", 1), (18, 0, "Real_page", 0), (19, 0, "Links_to_redir_page", 0), (20, 14, "This_is_hidden", 0), (21, 14, "Hidden_categories", 0)]
REDIRECTS = [(15, 0, "REDIR2"), (16, 0, "REDIR3"), (17, 0, "Real_page")]
LINKS = [(1, 14, "Main_category"), (3, 0, "P1"), (4, 0, "P1"), (5, 0, "P1"), (6, 0, "MESH2"), (6, 0, "MESH4"), (6, 0, "MESH7"), (7, 0, "MESH3"), (8, 0, "MESH1"), (9, 0, "MESH5"), (9, 0, "MESH6"), (10, 0, "MESH4"), (11, 0, "MESH1"), (12, 0, "MESH4"), (12, 0, "MESH5"), (12, 0, "MESH6"), (14, 0, "Main_Page"), (15, 0, "REDIR2"), (16, 0, "REDIR3"), (17, 0, "Real_page"), (19, 0, "REDIR1")]
CATEGORIES = [(1, "This_is_hidden"), *[(i, "Pages_with_P_prefix") for i in range(2, 6)], (20, "Hidden_categories")]


@pytest.fixture(scope="module")
def demo(spark, tmp_path_factory):
    """The demo wiki through dump files, one of them gzipped."""
    at = tmp_path_factory.mktemp("dumps")
    head = "-- MySQL dump\n/*!40101 SET NAMES utf8 */;\nDROP TABLE IF EXISTS `x`;\nCREATE TABLE `x` (\n  `a` int(8) DEFAULT '0'\n);\nLOCK TABLES `x` WRITE;\n"
    text = {
        "page": ",".join(f"({i},{ns},'{t}','',0,{r},0,0.5,'2011',1,2)" for i, ns, t, r in PAGES),
        "redirect": ",".join(f"({i},{ns},'{t}',NULL,NULL)" for i, ns, t in REDIRECTS),
        "pagelinks": ",".join(f"({i},{ns},'{t}')" for i, ns, t in LINKS),
        "categorylinks": ",".join(f"({i},'{t}','KEY','2011-01-01 00:00:00')" for i, t in CATEGORIES),
    }
    for name, rows in text.items():
        data = f"{head}INSERT INTO `{name}` VALUES {rows};\nUNLOCK TABLES;\n"
        if name == "pagelinks":
            with gzip.open(at / f"{name}.sql.gz", "wt") as f:
                f.write(data)
        else:
            (at / f"{name}.sql").write_text(data)
    return read_wiki(spark, f"file://{at}")


def test_tuples(spark):
    rows = [
        "-- comment; with (1,2)\nINSERT INTO page VALUES (1,0,'Main_Page','',3),(2,0,'Main_\\'Page\\\\','',1,0,1)",
        "/* INSERT INTO t VALUES (9) */ LOCK TABLES t WRITE",
        "insert into t (a, b) VALUES ('3')",
        "INSERT INTO t VALUES ('a),(b;c',NULL,-1.5e3)",
        "\n",
    ]
    got = [r.fields for r in tuples(spark.createDataFrame([(r,) for r in rows], "value string")).collect()]
    assert got == [["1", "0", "Main_Page", "", "3"], ["2", "0", "Main_'Page\\", "", "1", "0", "1"], ["3"], ["a),(b;c", None, "-1.5e3"]]
    long = "x" * 60_000 + "\\'" * 10
    got = tuples(spark.createDataFrame([(f"INSERT INTO t VALUES (1,'{long}')",)], "value string")).first().fields
    assert got[1] == "x" * 60_000 + "'" * 10


def test_missing_dump(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        resolve(spark, f"file://{tmp_path}/none.sql")
    with pytest.raises(FileNotFoundError):
        read_dump(spark, f"file://{tmp_path}/none.sql", "page")


def test_demo_load(demo):
    c = {r.metric: r.value for r in demo.counters.collect()}
    assert c == {"Articles": 14, "Article_redirects": 3, "Categories": 4, "Category_redirects": 0, "Graph_nodes": 18, "HiddenGraphId": 18, "StubGraphId": 0, "Article_links": 16, "Ignored_links_from_category": 1, "Ignored_links_to_category": 1, "Category_links": 4}
    edges = {(r.src, r.dst) for r in demo.article_edges.collect()}
    assert edges == {(3, 2), (4, 2), (5, 2), (6, 7), (6, 9), (6, 12), (7, 8), (8, 6), (9, 10), (9, 11), (10, 9), (11, 6), (12, 9), (12, 10), (12, 11), (16, 15)}
    assert {r.graph_id for r in demo.hidden.collect()} == {17, 18}
    assert {(r.rd_from, r.graph_id, r["pass"]) for r in demo.redirects.collect()} == {(17, 15, 1), (16, 15, 2), (15, 15, 3)}
    both = [(a, 13) for a in (2, 3, 4, 5)]
    assert sorted(map(tuple, demo.category_graph.edges.collect())) == sorted(both + [(b, a) for a, b in both])


def test_demo_report(spark, demo, tmp_path):
    r = report.analyze(demo)
    assert {(x.size, x["count"]) for x in r["article_components"].collect()} == {(1, 7), (7, 1)}
    assert {(x.size, x["count"]) for x in r["category_components"].collect()} == {(1, 13), (5, 1)}
    assert [x.n for x in r["article_spectrum"].orderBy("dist").collect()] == [14, 16, 13, 10, 6, 1]
    assert [x.n for x in r["category_spectrum"].orderBy("dist").collect()] == [18, 8, 12]
    t = r["article_totals"].first()
    assert (t.distance_sum, t.reachable_sum, t.avg_distance, t.avg_reachable) == (101, 46, 2.195652, 3.285714)
    t = r["category_totals"].first()
    assert (t.distance_sum, t.reachable_sum, t.avg_distance, t.avg_reachable) == (32, 20, 1.6, 1.111111)
    assert [(x.source, x.closeness) for x in r["article_closeness"].orderBy("closeness", "source").collect()] == [(6, 1.5), (12, 2.0), (8, 2.166667), (11, 2.166667), (9, 2.333333), (7, 2.833333), (10, 3.166667)]
    h = {x.source: x.count_dist for x in r["article_histograms"].collect()}
    assert h[7] == [1, 1, 1, 2, 2] and h[10] == [1, 1, 1, 1, 2, 1] and h[16] == [1, 1]
    ranks = {x.id: round(x["rank"], 6) for x in r["article_ranks"].collect()}
    assert ranks[9] == 0.188007 and ranks[6] == 0.181784 and ranks[15] == 0.032418
    order = [x.id for x in r["article_ranks"].orderBy(F.desc(F.round("rank", 9)), F.desc("id")).collect()]
    assert order[:9] == [9, 6, 11, 10, 8, 12, 7, 2, 15] and order[9:] == [16, 5, 4, 3, 1]
    page = report.page({"counters": r["counters"], "interesting": r["interesting"]})
    assert "Graph_nodes" in page and "Category:Pages_with_P_prefix" in page
    report.save({"counters": r["counters"]}, f"file://{tmp_path}/state")
    assert report.load(spark, f"file://{tmp_path}/state", ["counters"])["counters"].count() == 11


def test_category_ranks(demo):
    ranks, steps = traversal.pagerank(demo.category_graph)
    got = {x.id: round(x["rank"], 6) for x in ranks.collect()}
    assert steps == 36 and got[13] == 0.341642 and got[2] == 0.094446 and got[1] == 0.021583


def test_jobs(spark, demo, tmp_path):
    jobs = Jobs(demo)
    got = {r.job: r.result for r in jobs.run_all(["aD6", "cD13", "aI9", "aS", "cS", "aD13", "aD99", "cD0", "?"]).collect()}
    assert got == {
        "aD6": '{"count_dist":[1,3,3]}', "cD13": '{"count_dist":[1,4]}', "aI9": '{"in_degree":3,"out_degree":2}', "aS": '{"components":[[1,7],[7,1]]}',
        "cS": '{"components":[[1,13],[5,1]]}', "aD13": '{"error":"Node is category"}', "aD99": '{"error":"Node out of range"}',
        "cD0": '{"error":"Node out of range"}', "?": '{"error":"Unknown command"}',
    }
    assert jobs.run("aR").first().result.startswith('{"ranks":[[0.188007,9],[0.181784,6],[0.116894,11],[0.116894,10]')
    asked = spark.createDataFrame([("aD6",), ("aD7",)], "job string")
    log = spark.createDataFrame([(1, "aD6", "x")], "pos long, job string, result string")
    assert [r.job for r in jobs.missing(asked, log).collect()] == ["aD7"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/one.txt").write_text("aD6\naS\n")
    serve(jobs, f"file://{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/state").awaitTermination()
    assert {r.job for r in spark.read.parquet(f"file://{tmp_path}/out").collect()} == {"aD6", "aS"}


def test_redirect_order_and_odd_targets(spark):
    page = [(i, 0, f"R{i}", 1) for i in range(1, 8)] + [(100 + i, 0, f"B{i}", 1) for i in range(1, 7)] + [(200, 0, "End", 0), (201, 14, "Cat", 0), (300, 0, "ToCat", 1), (301, 14, "ToArticle", 1), (302, 0, "Self", 1), (303, 0, "Lost", 1), (400, 0, "From", 0), (401, 14, "Top", 0)]
    forward = [(i, 0, f"R{i + 1}") for i in range(1, 6)] + [(6, 0, "End"), (7, 0, "R7")]
    backward = [(101, 0, "End")] + [(100 + i, 0, f"B{i - 1}") for i in range(2, 7)]
    redirect = forward + backward + [(300, 14, "Cat"), (301, 0, "End"), (302, 0, "Self"), (303, 0, "Nowhere")]
    links = [(400, 0, "End"), (400, 0, "B1"), (400, 0, "ToCat"), (200, 0, "B6"), (401, 14, "Cat"), (401, 0, "End"), (400, 0, "R1")]
    cats = [(400, "ToArticle"), (401, "Cat")]
    w = Wiki(spark.createDataFrame(page, "page_id long, ns int, title string, is_redirect int"), spark.createDataFrame(redirect, "rd_from long, ns int, title string"), spark.createDataFrame(links, "pl_from long, ns int, title string"), spark.createDataFrame(cats, "cl_from long, cl_to string"))
    ids = {r.title: r.graph_id for r in w.nodes.collect()}
    passes = {r.rd_from: r["pass"] for r in w.redirects.collect()}
    assert {k: passes.get(k) for k in range(1, 8)} == {6: 1, 5: 2, 4: 3, 3: 4, 2: None, 1: None, 7: None}
    assert all(passes[100 + i] == 1 for i in range(1, 7)) and 302 not in passes and 303 not in passes
    e, f, c = ids["End"], ids["From"], ids["Cat"]
    assert sorted(map(tuple, w.article_edges.collect())) == sorted([(f, e), (f, e), (e, e)])
    assert tuple(w.ignored.first()) == (2, 0)
    assert sorted(map(tuple, w.category_forward.collect())) == sorted([(f, e), (ids["Top"], c)])


def test_command_line(spark, demo, tmp_path, monkeypatch, capsys):
    from linkatlas import __main__ as cli
    from linkatlas.sources.store import read_log

    monkeypatch.setattr(cli, "read_wiki", lambda *_: demo)
    answers = f"file://{tmp_path}/answers"
    cli.main(["--sample", "5", "explore", "dumps", answers])
    log = read_log(spark, answers)
    assert log.count() == 5 and all(r.job.startswith("cD") for r in log.collect())
    known = log.first().job
    cli.main(["jobs", "dumps", known, "aD6", "aD7", "cS", "--log", answers])
    out = dict(line.split("\t") for line in capsys.readouterr().out.splitlines())
    assert out["aD6"] == '{"count_dist":[1,3,3]}' and out["aD7"] == '{"count_dist":[1,1,1,2,2]}' and out["cS"].startswith('{"components"') and known in out
    cli.main(["--sample", "4", "report", "dumps", str(tmp_path / "r.html"), "--state", f"file://{tmp_path}/state"])
    page = (tmp_path / "r.html").read_text()
    assert "article_coverage" in page and "article_rank_percent" in page
    cli.main(["report", "dumps", str(tmp_path / "again.html"), "--load", f"file://{tmp_path}/state"])
    assert "article_components_largest_first" in (tmp_path / "again.html").read_text()
    cli.main(["print", "dumps", f"file://{tmp_path}/text"])
    assert {r.value for r in spark.read.text(f"file://{tmp_path}/text/article").collect()} >= {"7: 8", "6: 7 9 12"}
