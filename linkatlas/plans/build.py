"""From page, redirect and link tables to an article graph and a category graph.

Titles are resolved once and replaced by dense node ids; every later join is on integers. Links keep
their multiplicity throughout.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import Graph
from ..operators.numbering import dense_ids
from ..operators.traversal import Steps
from ..scratch import cut

ARTICLE, CATEGORY = 0, 14
HIDDEN, STUB = "Hidden_categories", "Stub_categories"
#: Sequential passes after which unresolved redirects stay so.
PASSES = 4


@dataclass
class Wiki:
    """The four input tables.

    page(page_id, ns, title, is_redirect), redirect(rd_from, ns, title), pagelinks(pl_from, ns, title),
    categorylinks(cl_from, cl_to).
    """

    page: DataFrame
    redirect: DataFrame
    pagelinks: DataFrame
    categorylinks: DataFrame
    passes: int = PASSES
    _kept: dict = field(default_factory=dict, repr=False)

    @cached_property
    def pages(self) -> DataFrame:
        """Pages of the two namespaces that count."""
        return self.page.where(F.col("ns").isin(ARTICLE, CATEGORY)).select(
            F.col("page_id").cast("long"), "ns", "title", (F.col("is_redirect") == 1).alias("is_redirect"), (F.col("ns") == CATEGORY).alias("is_category")
        )

    @cached_property
    def nodes(self) -> DataFrame:
        """Regular pages with their dense node ids: page_id, ns, title, is_category, graph_id."""
        return cut(dense_ids(self.pages.where("not is_redirect").drop("is_redirect"), "page_id", "graph_id"), "nodes")

    @cached_property
    def redirects(self) -> DataFrame:
        """Redirects that resolve: rd_from, ns, title (their own), graph_id, is_category (their target's), pass.

        A redirect to a regular page resolves in pass 1; one to another redirect in that one's pass, or the
        next if that one stands later in the table (by rd_from). More than ``passes`` is unresolved.
        """
        own = self.pages.where("is_redirect").select(F.col("page_id").alias("rd_from"), F.col("ns").alias("own_ns"), F.col("title").alias("own_title"))
        rows = self.redirect.where(F.col("ns").isin(ARTICLE, CATEGORY)).select(F.col("rd_from").cast("long"), "ns", "title").join(own, "rd_from")
        target = self.nodes.select("ns", "title", "graph_id", "is_category")
        done = rows.join(target, ["ns", "title"]).select("rd_from", F.col("own_ns").alias("ns"), F.col("own_title").alias("title"), "graph_id", "is_category", F.lit(1).alias("pass"))
        done = new = cut(done, "redirects")
        # Chains by id: which redirect points at which.
        chain = rows.join(own.select(F.col("rd_from").alias("to"), F.col("own_ns").alias("ns"), F.col("own_title").alias("title")), ["ns", "title"])
        chain = cut(chain.select("rd_from", "own_ns", "own_title", "to"), "chain")
        while True:
            ahead = new.select(F.col("rd_from").alias("to"), "graph_id", "is_category", "pass")
            step = chain.join(ahead, "to").withColumn("pass", F.col("pass") + F.when(F.col("to") > F.col("rd_from"), 1).otherwise(0)).where(F.col("pass") <= self.passes)
            new = cut(step.select("rd_from", F.col("own_ns").alias("ns"), F.col("own_title").alias("title"), "graph_id", "is_category", "pass"), "redirects")
            if new.isEmpty():
                return done
            done = done.unionByName(new)

    @cached_property
    def names(self) -> DataFrame:
        """Every title that names a node: regular pages and resolved redirects."""
        cols = ["ns", "title", "graph_id", "is_category"]
        return cut(self.nodes.select(cols).unionByName(self.redirects.select(cols)), "names")

    @cached_property
    def _from_pages(self) -> DataFrame:
        """Page links with a regular source."""
        source = self.nodes.select(F.col("page_id").alias("pl_from"), F.col("graph_id").alias("src"), F.col("is_category").alias("from_category"))
        return cut(self.pagelinks.select(F.col("pl_from").cast("long"), "ns", "title").join(source, "pl_from").select("src", "from_category", "ns", "title"), "links")

    @cached_property
    def article_edges(self) -> DataFrame:
        """(src, dst) with parallel edges and self-loops."""
        links = self._from_pages.where((F.col("ns") == ARTICLE) & ~F.col("from_category"))
        return links.join(self.names.select("ns", "title", F.col("graph_id").alias("dst"), "is_category"), ["ns", "title"]).where("not is_category").select("src", "dst")

    @cached_property
    def ignored(self) -> DataFrame:
        """Page links left out because of their source, or else because of their target's namespace."""
        return self._from_pages.agg(
            F.count_if(F.expr("from_category")).alias("from_category"), F.count_if(~F.col("from_category") & (F.col("ns") == CATEGORY)).alias("to_category")
        )

    @cached_property
    def _category_links(self) -> DataFrame:
        source = self.nodes.select(F.col("page_id").alias("cl_from"), F.col("graph_id").alias("src"))
        target = self.names.where(F.col("ns") == CATEGORY).select(F.col("title").alias("cl_to"), F.col("graph_id").alias("dst"))
        return cut(self.categorylinks.select(F.col("cl_from").cast("long"), "cl_to").join(source, "cl_from").join(target, "cl_to").select("src", "dst"), "links")

    @cached_property
    def seeds(self) -> DataFrame:
        return self.nodes.where((F.col("ns") == CATEGORY) & F.col("title").isin(HIDDEN, STUB)).select("graph_id", "title")

    @cached_property
    def hidden(self) -> DataFrame:
        """(graph_id): the seeds and both ends of every category link that touches one."""
        seed = self.seeds.select("graph_id")
        links = self._category_links
        near = links.join(seed.withColumnRenamed("graph_id", "src"), "src", "left_semi").unionByName(links.join(seed.withColumnRenamed("graph_id", "dst"), "dst", "left_semi").select("src", "dst"))
        ends = near.select(F.explode(F.array("src", "dst")).alias("graph_id"))
        return cut(ends.unionByName(seed).distinct(), "hidden")

    @cached_property
    def category_forward(self) -> DataFrame:
        gone = self.hidden
        return (
            self._category_links.join(gone.withColumnRenamed("graph_id", "src"), "src", "left_anti")
            .join(gone.withColumnRenamed("graph_id", "dst"), "dst", "left_anti").select("src", "dst")
        )

    @cached_property
    def article_graph(self) -> Graph:
        """Articles and their links; categories are not its nodes."""
        return Graph(cut(self.nodes.where("not is_category").select(F.col("graph_id").alias("id")), "vertices"), cut(self.article_edges, "edges"))

    @cached_property
    def category_graph(self) -> Graph:
        """All nodes, with category links in both directions."""
        forward = Graph(cut(self.nodes.select(F.col("graph_id").alias("id")), "vertices"), self.category_forward)
        both = forward.add(forward.transpose())
        return Graph(both.nodes, cut(both.edges, "edges"))

    @cached_property
    def article_steps(self) -> Steps:
        """The article graph with each link once, without loops."""
        known = self.__dict__.get("article_graph")
        nodes = known.nodes if known else cut(self.nodes.where("not is_category").select(F.col("graph_id").alias("id")), "vertices")
        return Steps(nodes, cut((known.edges if known else self.article_edges).where("src <> dst").distinct(), "steps"))

    @cached_property
    def category_steps(self) -> Steps:
        """The category graph with each link once in both directions, without loops."""
        a, b = F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")
        half = cut(self.category_forward.where("src <> dst").select(a, b).distinct(), "steps")
        return Steps(cut(self.nodes.select(F.col("graph_id").alias("id")), "vertices"), half.unionByName(half.select(F.col("dst").alias("src"), F.col("src").alias("dst"))), half)

    @cached_property
    def counters(self) -> DataFrame:
        """(metric, value): what the load has seen."""
        p = self.pages.agg(
            F.count_if(F.expr("not is_category and not is_redirect")).alias("Articles"), F.count_if(F.expr("not is_category and is_redirect")).alias("Article_redirects"),
            F.count_if(F.expr("is_category and not is_redirect")).alias("Categories"), F.count_if(F.expr("is_category and is_redirect")).alias("Category_redirects"),
        )
        n = self.nodes.agg(F.count("*").alias("Graph_nodes"))
        s = self.seeds.agg(F.coalesce(F.max(F.when(F.col("title") == HIDDEN, F.col("graph_id"))), F.lit(0)).alias("HiddenGraphId"), F.coalesce(F.max(F.when(F.col("title") == STUB, F.col("graph_id"))), F.lit(0)).alias("StubGraphId"))
        i = self.ignored.select(F.col("from_category").alias("Ignored_links_from_category"), F.col("to_category").alias("Ignored_links_to_category"))
        a = self.article_graph.edges.agg(F.count("*").alias("Article_links"))
        c = self.category_forward.agg(F.count("*").alias("Category_links"))
        out = None
        for one in (p, n, s, a, i, c):
            part = one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).cast("long").alias("value")) for k in one.columns])).alias("m")).select("m.*")
            out = part if out is None else out.unionByName(part)
        return out
