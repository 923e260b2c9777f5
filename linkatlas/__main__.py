"""Command line: ``python -m linkatlas COMMAND DUMPS``; DUMPS is a folder of page, redirect, pagelinks and categorylinks dumps."""

from __future__ import annotations

import argparse
from pathlib import Path

from .plans import report
from .plans.commands import Jobs
from .session import session
from .sources.dump import read_wiki
from .sources.store import read_log, write_graph, write_text


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="linkatlas", description=__doc__)
    p.add_argument("--master", help="Spark master; the one of the environment if left out")
    p.add_argument("--prefix", default="", help="what the dumps' names begin with")
    p.add_argument("--seed", type=int, default=42, help="seed of the permutation that samples nodes")
    p.add_argument("--sample", type=int, help="how many nodes to search from; all if left out")
    sub = p.add_subparsers(dest="command", required=True)
    for name, about in (("report", "write the report page"), ("jobs", "answer jobs"), ("explore", "fill a folder of answers, without a report"), ("graph", "write both graphs"), ("print", "write both graphs as adjacency text")):
        one = sub.add_parser(name, help=about)
        one.add_argument("dumps")
        if name == "jobs":
            one.add_argument("jobs", nargs="+")
            one.add_argument("--log", help="folder of answers that need not be computed again")
        else:
            one.add_argument("out")
        if name == "report":
            one.add_argument("--state", help="folder to save the report's tables in")
            one.add_argument("--load", help="folder of a saved report's tables, used in place of the dumps")
    return p


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    spark = session(a.master)
    if a.command == "report" and a.load:
        names = sorted(x.name for x in Path(a.load.removeprefix("file://")).iterdir() if x.is_dir())
        Path(a.out).write_text(report.page(report.load(spark, a.load, names)))
        return
    wiki = read_wiki(spark, a.dumps, a.prefix)
    if a.command == "report":
        tables = report.analyze(wiki, a.sample, a.seed)
        if a.state:
            report.save(tables, a.state)
        Path(a.out).write_text(report.page(tables))
    elif a.command == "jobs":
        jobs = Jobs(wiki)
        answers = jobs.resume(a.jobs, read_log(spark, a.log)) if a.log else jobs.run_all(a.jobs)
        for r in answers.toLocalIterator():
            print(r["job"], r["result"], sep="\t")
    elif a.command == "explore":
        jobs = Jobs(wiki)
        jobs.explore(a.out, jobs.total if a.sample is None else a.sample, a.seed)
    else:
        for kind, graph in (("article", wiki.article_graph), ("category", wiki.category_graph)):
            (write_graph if a.command == "graph" else write_text)(graph, f"{a.out}/{kind}")


if __name__ == "__main__":
    main()
