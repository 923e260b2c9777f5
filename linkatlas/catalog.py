"""Named queries over the driver's tables and the SQL that checks them.

The star-schema tables are seen as a wiki through views whose text both engines run: parts are articles
(each twentieth a redirect), suppliers, nations and regions are categories, consecutive order lines are
links.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import metrics
from .functions.formats import counted, percent, permutation, pretty, qualified
from .operators import traversal
from .plans import report
from .plans.build import Wiki
from .plans.commands import Jobs
from .scratch import cut
from .sources.dump import tuples
from .sources.store import adjacency_text, first_answers

VIEWS = {
    "w_page": """
select p_partkey+1 as page_id, 0 as ns, concat('P',p_partkey) as title, case when p_partkey%20=19 then 1 else 0 end as is_redirect from part
union all select 10000000+s_suppkey, 14, concat('S',s_suppkey), 0 from supplier
union all select 20000000+n_nationkey, 14, concat('N',n_nationkey), 0 from nation
union all select 30000000+r_regionkey, 14, case r_regionkey when 0 then 'Hidden_categories' when 4 then 'Stub_categories' else concat('R',r_regionkey) end, 0 from region""",
    "w_redirect": """
select p_partkey+1 as rd_from, 0 as ns, concat('P', case when p_partkey%100=99 then p_partkey+1 else p_partkey+20 end) as title from part where p_partkey%20=19""",
    "w_pagelinks": """
select distinct a.l_partkey+1 as pl_from, 0 as ns, concat('P',b.l_partkey) as title
from lineitem a join lineitem b on a.l_orderkey=b.l_orderkey and b.l_linenumber=a.l_linenumber+1
union all select 10000000+s_suppkey, 0, concat('P',s_suppkey) from supplier where s_suppkey%3=0
union all select 10000000+s_suppkey, 14, concat('N',s_nationkey) from supplier where s_suppkey%4=0
union all select p_partkey+1, 14, concat('S',p_partkey%10) from part where p_partkey%7=0""",
    "w_categorylinks": """
select distinct l_partkey+1 as cl_from, concat('S',l_suppkey) as cl_to from lineitem where l_linenumber=1
union all select 10000000+s_suppkey, concat('N',s_nationkey) from supplier
union all select 20000000+n_nationkey, case n_regionkey when 0 then 'Hidden_categories' when 4 then 'Stub_categories' else concat('R',n_regionkey) end from nation""",
}
#: SOURCES is how many nodes ``permutation_sample``, ``sampling_coverage`` and ``node_detail`` pick; the distance queries search from all nodes.
SOURCES, SEED, TOP = 20, 42, 100


def wiki(spark: SparkSession, sf_dir: str) -> Wiki:
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("part", "supplier", "nation", "region", "lineitem")}
    frames = {name: spark.sql(_named(text, tables), **{t: df for t, df in tables.items() if f"{{{t}}}" in _named(text, tables)}) for name, text in VIEWS.items()}
    return Wiki(frames["w_page"], frames["w_redirect"], frames["w_pagelinks"], frames["w_categorylinks"])


def _named(text: str, tables: dict) -> str:
    """The view's text with its tables as parameters, so that no name is registered in the session."""
    return re.sub(rf"\b(from|join) ({'|'.join(tables)})\b", r"\1 {\2}", text)


def _names(w: Wiki) -> DataFrame:
    return w.nodes.select(F.col("graph_id").alias("id"), pretty(F.col("ns"), F.col("title")).alias("name"))


def _sources(w: Wiki, graph) -> DataFrame:
    return permutation(w.page.sparkSession, w.nodes.count(), SEED, SOURCES).select(F.col("k").alias("id")).join(graph.nodes, "id", "left_semi")


def load_counters(spark, d):
    return wiki(spark, d).counters


def page_nodes(spark, d):
    return wiki(spark, d).nodes.select("page_id", "ns", "title", "graph_id")


def redirect_resolution(spark, d):
    return wiki(spark, d).redirects.select("rd_from", "graph_id", "pass")


def name_dictionary(spark, d):
    n = wiki(spark, d).names
    return n.select("graph_id", qualified(F.col("ns"), F.col("title")).alias("key"), pretty(F.col("ns"), F.col("title")).alias("name"))


def article_edges(spark, d):
    return wiki(spark, d).article_edges


def ignored_links(spark, d):
    return wiki(spark, d).ignored


def hidden_nodes(spark, d):
    return wiki(spark, d).hidden


def category_edges_fw(spark, d):
    return wiki(spark, d).category_forward


def category_edges_transposed(spark, d):
    w = wiki(spark, d)
    from .operators.graph import Graph

    return Graph(w.nodes, w.category_forward).transpose().edges


def category_graph(spark, d):
    return wiki(spark, d).category_graph.edges


def degree_article(spark, d):
    return wiki(spark, d).article_graph.degrees()


def degree_category(spark, d):
    return wiki(spark, d).category_graph.degrees()


def adjacency_list(spark, d):
    return adjacency_text(wiki(spark, d).article_graph)


def graph_sanity(spark, d):
    return wiki(spark, d).article_graph.size()


def in_degree_runs(spark, d):
    return counted(wiki(spark, d).article_graph.degrees(), "in_degree")


def _articles(w: Wiki, below: int | None = None, **how) -> DataFrame:
    graph = w.article_steps
    return traversal.search(graph, graph.nodes, below, known=traversal.pieces(graph, cycles=True), **how)


def bfs_histogram_article(spark, d):
    return _articles(wiki(spark, d))


def bfs_histogram_category(spark, d):
    graph = wiki(spark, d).category_steps
    return traversal.search(graph, graph.nodes, known=traversal.pieces(graph))


def distance_spectrum(spark, d):
    return metrics.spectrum(_articles(wiki(spark, d), pooled=True))


def _near(w: Wiki) -> tuple[DataFrame, int]:
    """``closeness`` of all articles, and the size of the largest strong component."""
    graph = w.article_steps
    known = traversal.pieces(graph, cycles=True)
    largest = traversal.sizes(known.cycles).agg(F.max("size")).first()[0]
    return metrics.closeness(traversal.search(graph, graph.nodes, summed=True, known=known)), largest


def distance_totals(spark, d):
    near, largest = _near(wiki(spark, d))
    return metrics.totals(cut(near), largest)


def closeness_topk(spark, d):
    return metrics.most_central(*_near(wiki(spark, d)))


def scc_sizes_article(spark, d):
    return traversal.sizes(traversal.strong(wiki(spark, d).article_graph))


def cc_sizes_category(spark, d):
    return traversal.sizes(traversal.connected(wiki(spark, d).category_graph))


def pagerank_topk(spark, d):
    w = wiki(spark, d)
    ranks, _ = traversal.pagerank(w.article_graph)
    top = ranks.orderBy(F.desc(F.round("rank", 9)), F.desc("id")).limit(TOP)
    return top.join(_names(w), "id").select("id", "name", F.round("rank", 6).alias("rank"))


def node_detail(spark, d):
    w = wiki(spark, d)
    ids = permutation(spark, w.nodes.count(), SEED, SOURCES).select(F.col("k").alias("id"))
    out = report.detail(w, ids)
    return out.select("id", "name", "article_in", "article_out", "category_in", "category_out", *[F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) for c in ("article_dist", "category_dist")], F.coalesce(F.array_max("article_dist"), F.lit(0)).cast("long").alias("max_count"))


def _near_category(w: Wiki) -> tuple[DataFrame, int]:
    graph = w.category_steps
    known = traversal.pieces(graph)
    largest = traversal.sizes(known.joined).agg(F.max("size")).first()[0]
    return metrics.closeness(traversal.search(graph, graph.nodes, summed=True, known=known)), largest


def interesting_nodes(spark, d):
    w = wiki(spark, d)
    ranks, _ = traversal.pagerank(w.article_graph)
    out = ranks.orderBy(F.desc(F.round("rank", 9)), F.desc("id")).limit(TOP).select("id")
    for near in (_near, _near_category):
        out = out.union(metrics.most_central(*near(w)).select(F.col("source").alias("id")))
    return out.distinct().join(_names(w), "id")


def distance_totals_category(spark, d):
    near, largest = _near_category(wiki(spark, d))
    return metrics.totals(cut(near), largest)


def sampling_coverage(spark, d):
    w = wiki(spark, d)
    out = None
    for kind, graph in (("article", w.article_graph), ("category", w.category_graph)):
        near = metrics.closeness(traversal.search(graph, _sources(w, graph)))
        part = metrics.coverage(near, graph.nodes.count()).withColumn("graph", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return out


def rank_percent(spark, d):
    ranks, _ = traversal.pagerank(wiki(spark, d).article_graph)
    top = ranks.select("id", F.round("rank", 9).alias("rank")).orderBy(F.desc("rank"), F.desc("id")).limit(TOP)
    return top.select("id", percent(F.col("rank"), 3).alias("percent"))


def spectrum_shown(spark, d):
    return metrics.spectrum(_articles(wiki(spark, d), metrics.SPECTRUM_SHOWN, pooled=True))


def histograms_shown(spark, d):
    return _articles(wiki(spark, d), metrics.HISTOGRAM_SHOWN)


def components_largest_first(spark, d):
    return metrics.largest_first(scc_sizes_article(spark, d))


def category_rank_job(spark, d):
    return Jobs(wiki(spark, d)).run("cR")


def permutation_sample(spark, d):
    return permutation(spark, wiki(spark, d).nodes.count(), SEED, SOURCES)


def job_results(spark, d):
    w = wiki(spark, d)
    return Jobs(w).run_all(["aD5", "cD5", "aI5", "cI5", "aS", "cS", "aD0", "aD999999999", f"aD{w.nodes.count()}", "xyz"])


def pagerank_job(spark, d):
    return Jobs(wiki(spark, d)).run("aR")


def answer_log(spark, d):
    """First answers of a replayed log: each order is an answer to its customer's job."""
    orders = spark.read.parquet(f"{d}/orders.parquet")
    log = orders.select(F.col("o_orderkey").alias("pos"), F.concat(F.lit("aD"), F.col("o_custkey")).alias("job"), F.col("o_orderstatus").alias("result"))
    return first_answers(log)


def cache_missing_nodes(spark, d):
    """Distance and degree jobs of each customer's number that a log of distance jobs does not answer."""
    asked = spark.read.parquet(f"{d}/customer.parquet").select(F.explode(F.array(*[F.concat(F.lit(c), F.col("c_custkey")) for c in ("aD", "aI")])).alias("job"))
    log = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("pos"), F.concat(F.lit("aD"), F.col("o_custkey")).alias("job"), F.col("o_orderstatus").alias("result"))
    return Jobs.missing(asked, log)


def dump_scan(spark, d):
    """Parts written as an insert statement's tuples and read back through the dump scan's patterns."""
    part = spark.read.parquet(f"{d}/part.parquet")
    name = F.regexp_replace("p_name", r"(['\\])", r"\\$1")
    row = F.format_string("(%d,NULL,'it\\'s; (%s)','%s',-1.5e3)", F.col("p_partkey"), name, F.col("p_brand"))
    text = part.select(F.concat(F.lit("-- parts\n/* all */ INSERT INTO `part` VALUES "), row).alias("value"))
    f = tuples(text)
    return f.select(*[F.get("fields", F.lit(i)).try_cast(t).alias(n) for i, (n, t) in enumerate([("k", "long"), ("nothing", "string"), ("name", "string"), ("brand", "string"), ("x", "double")])])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    pagerank_topk, load_counters, page_nodes, redirect_resolution, name_dictionary, article_edges, ignored_links, hidden_nodes, category_edges_fw,
    category_edges_transposed, category_graph, degree_article, degree_category, adjacency_list, graph_sanity, in_degree_runs, bfs_histogram_article,
    bfs_histogram_category, distance_spectrum, distance_totals, closeness_topk, scc_sizes_article, cc_sizes_category, node_detail, interesting_nodes,
    permutation_sample, job_results, pagerank_job, answer_log, cache_missing_nodes, dump_scan, distance_totals_category, sampling_coverage, rank_percent,
    spectrum_shown, histograms_shown, components_largest_first, category_rank_job,
)}

_BASE = "with recursive " + ",\n".join(f"{k} as materialized ({v})" for k, v in VIEWS.items()) + """,
pages as (select page_id, ns, title, is_redirect = 1 as is_redirect, ns = 14 as is_category from w_page where ns in (0, 14)),
nodes as materialized (select page_id, ns, title, is_category, row_number() over (order by page_id) as graph_id from pages where not is_redirect),
rr as materialized (select r.rd_from, r.ns, r.title, p.ns as own_ns, p.title as own_title from w_redirect r join pages p on p.page_id = r.rd_from and p.is_redirect where r.ns in (0, 14)),
res(rd_from, graph_id, is_category, pass) as (
  select rd_from, graph_id, is_category, 1 from rr join nodes n on n.ns = rr.ns and n.title = rr.title
  union all
  select r.rd_from, p.graph_id, p.is_category, p.pass + case when p.rd_from > r.rd_from then 1 else 0 end
  from rr r join rr o on o.own_ns = r.ns and o.own_title = r.title join res p on p.rd_from = o.rd_from
  where p.pass + case when p.rd_from > r.rd_from then 1 else 0 end <= 4),
names as materialized (select ns, title, graph_id, is_category from nodes union all select rr.own_ns, rr.own_title, res.graph_id, res.is_category from res join rr using (rd_from)),
pl as (select n.graph_id as src, n.is_category as from_category, l.ns, l.title from w_pagelinks l join nodes n on n.page_id = l.pl_from),
art as materialized (select pl.src, t.graph_id as dst from pl join names t on t.ns = pl.ns and t.title = pl.title where pl.ns = 0 and not pl.from_category and not t.is_category),
ign as (select cast(count(*) filter (where from_category) as bigint) as from_category, cast(count(*) filter (where not from_category and ns = 14) as bigint) as to_category from pl),
cl as materialized (select n.graph_id as src, t.graph_id as dst from w_categorylinks l join nodes n on n.page_id = l.cl_from join names t on t.ns = 14 and t.title = l.cl_to),
seeds as (select graph_id, title from nodes where ns = 14 and title in ('Hidden_categories', 'Stub_categories')),
hid as materialized (select graph_id from seeds union select unnest([src, dst]) from cl where src in (select graph_id from seeds) or dst in (select graph_id from seeds)),
fw as materialized (select src, dst from cl where src not in (select graph_id from hid) and dst not in (select graph_id from hid)),
cat as materialized (select src, dst from fw union all select dst, src from fw),
arts as (select graph_id as id from nodes where not is_category),
nm as (select graph_id as id, case when ns = 14 then concat('Category:', title) else title end as name from nodes),
cnt as (select count(*) as n from nodes),
stride as (select min(s) as s from (select unnest(range(42, 1042)) as s), cnt where gcd(s, n) = 1),
perm as (select i, (((i - 1) * s) % n + 1)::bigint as k from (select unnest(range(1, 21)) as i), cnt, stride where i <= n)
"""


def _reach(edges: str, nodes: str, sources: str = "") -> str:
    return f""",
step_{edges} as materialized (select distinct src, dst from {edges}),
walk_{edges}(source, node, dist) using key (source, node) as (
  select s.id, s.id, 0 from {sources or nodes} s where s.id in (select id from {nodes})
  union
  select w.source, e.dst, min(w.dist) + 1 from walk_{edges} w join step_{edges} e on e.src = w.node
  where not exists (select 1 from recurring.walk_{edges} r where r.source = w.source and r.node = e.dst) group by w.source, e.dst),
reach_{edges} as materialized (select source, node, dist from walk_{edges})
"""


_SCC = """,
eu as materialized (select distinct src, dst from art where src <> dst),
reach(a, b) as (select src, dst from eu union select r.a, e.dst from reach r join eu e on e.src = r.b),
lab as (select arts.id, least(arts.id, coalesce(min(r.b), arts.id)) as label from arts left join (select x.a, x.b from reach x join reach y on x.a = y.b and x.b = y.a) r on r.a = arts.id group by arts.id),
scc as materialized (select size, count(*) as "count" from (select label, count(*) as size from lab group by label) group by size)
"""
_PR = """,
an as (select count(*) as n from arts),
od as (select src, count(*) as o from art group by src),
we as materialized (select art.src, art.dst, count(*) / any_value(o) as w from art join od using (src) group by art.src, art.dst),
pr(it, id, rank) as (
  select 0, id, 1.0::double / n from arts, an
  union all
  select it + 1, id, 0.15 / any_value(n) + sum(c) from (
    select it, id, 0.0::double as c from pr where it < 60 union all select pr.it, we.dst, 0.85 * pr.rank * we.w from pr join we on we.src = pr.id where pr.it < 60), an
  group by it, id),
dl as (select b.it, sum(abs(b.rank - a.rank)) as delta, sum(b.rank) as total from pr a join pr b on b.it = a.it + 1 and a.id = b.id group by b.it),
ended as (select it, total from dl where delta < 1e-3 order by it limit 1),
ranks as materialized (select id, rank / total as rank from pr join ended using (it)),
top as materialized (select id, rank from ranks order by round(rank, 9) desc, id desc limit 100)
"""
_NEAR = """,
near as materialized (select source, count(*) filter (where dist >= 1) as reachable, cast(sum(dist) as bigint) as distances from reach_art group by source),
big as (select max(size) as largest from scc),
central as (select source, round(distances / greatest(reachable, 1), 6) as closeness, reachable from near, big where reachable + 1 >= largest order by closeness, source limit 100)
"""
_CPR = re.sub(r"\barts\b", "(select graph_id as id from nodes)", re.sub(r"\bart\b", "cat", _PR))
_CNEAR = """,
grow(a, b) as (select graph_id, graph_id from nodes union select g.a, c.dst from grow g join (select distinct src, dst from cat) c on c.src = g.b),
cc as (select size, count(*) as "count" from (select label, count(*) as size from (select a, min(b) as label from grow group by a) group by label) group by size),
cnear as materialized (select source, count(*) filter (where dist >= 1) as reachable, cast(sum(dist) as bigint) as distances from reach_cat group by source),
cbig as (select max(size) as largest from cc),
ccentral as (select source from (select source, round(distances / greatest(reachable, 1), 6) as closeness, reachable from cnear, cbig where reachable + 1 >= largest order by closeness, source limit 100))
"""
_BOTH = """,
din as (select dst as id, count(*) as n from art group by dst), dout as (select src as id, count(*) as n from art group by src),
cin as (select dst as id, count(*) as n from cat group by dst), cout as (select src as id, count(*) as n from cat group by src)
"""


def _hist(edges: str) -> str:
    return f"(select source, list(n order by dist) as h from (select source, dist, count(*) as n from reach_{edges} group by source, dist) group by source)"


SQL: dict[str, str] = {
    "load_counters": _BASE + """
select metric, cast(value as bigint) as value from (
  select 'Articles' as metric, count(*) as value from pages where not is_category and not is_redirect
  union all select 'Article_redirects', count(*) from pages where not is_category and is_redirect
  union all select 'Categories', count(*) from pages where is_category and not is_redirect
  union all select 'Category_redirects', count(*) from pages where is_category and is_redirect
  union all select 'Graph_nodes', count(*) from nodes
  union all select 'HiddenGraphId', coalesce(max(graph_id), 0) from seeds where title = 'Hidden_categories'
  union all select 'StubGraphId', coalesce(max(graph_id), 0) from seeds where title = 'Stub_categories'
  union all select 'Ignored_links_from_category', from_category from ign
  union all select 'Ignored_links_to_category', to_category from ign
  union all select 'Article_links', count(*) from art
  union all select 'Category_links', count(*) from fw)""",
    "page_nodes": _BASE + "select page_id, ns, title, graph_id from nodes",
    "redirect_resolution": _BASE + "select rd_from, graph_id, pass from res",
    "name_dictionary": _BASE + "select graph_id, concat(case when ns = 14 then 'c:' else 'a:' end, title) as key, case when ns = 14 then concat('Category:', title) else title end as name from names",
    "article_edges": _BASE + "select src, dst from art",
    "ignored_links": _BASE + "select from_category, to_category from ign",
    "hidden_nodes": _BASE + "select graph_id from hid",
    "category_edges_fw": _BASE + "select src, dst from fw",
    "category_edges_transposed": _BASE + "select dst as src, src as dst from fw",
    "category_graph": _BASE + "select src, dst from cat",
    "degree_article": _BASE + _BOTH + "select arts.id, coalesce(din.n, 0) as in_degree, coalesce(dout.n, 0) as out_degree from arts left join din on din.id = arts.id left join dout on dout.id = arts.id",
    "degree_category": _BASE + _BOTH + "select graph_id as id, coalesce(cin.n, 0) as in_degree, coalesce(cout.n, 0) as out_degree from nodes left join cin on cin.id = graph_id left join cout on cout.id = graph_id",
    "adjacency_list": _BASE + "select concat(src, ': ', string_agg(cast(dst as varchar), ' ' order by dst)) as value from art group by src",
    "graph_sanity": _BASE + "select (select count(*) from arts) as num_nodes, (select count(*) from art) as num_edges, (select count(*) from art where dst not in (select id from arts)) as stray_edges",
    "in_degree_runs": _BASE + _BOTH + 'select value, count(*) as "count" from (select coalesce(din.n, 0) as value from arts left join din on din.id = arts.id) group by value',
    "bfs_histogram_article": _BASE + _reach("art", "arts") + "select source, dist, count(*) as n from reach_art group by source, dist",
    "bfs_histogram_category": _BASE + _reach("cat", "nm") + "select source, dist, count(*) as n from reach_cat group by source, dist",
    "distance_spectrum": _BASE + _reach("art", "arts") + "select dist, count(*) as n from reach_art group by dist",
    "distance_totals": _BASE + _reach("art", "arts") + _SCC + _NEAR + """select count(*) as nodes_done, cast(sum(distances) as bigint) as distance_sum, cast(sum(reachable) as bigint) as reachable_sum,
  count(*) filter (where reachable + 1 >= largest) as eligible, round(sum(distances) / sum(reachable), 6) as avg_distance, round(sum(reachable) / count(*), 6) as avg_reachable from near, big""",
    "closeness_topk": _BASE + _reach("art", "arts") + _SCC + _NEAR + "select source, closeness, reachable from central",
    "scc_sizes_article": _BASE + _SCC + 'select size, "count" from scc',
    "cc_sizes_category": _BASE + """,
grow(a, b) as (select graph_id, graph_id from nodes union select g.a, c.dst from grow g join (select distinct src, dst from cat) c on c.src = g.b)
select size, count(*) as "count" from (select label, count(*) as size from (select a, min(b) as label from grow group by a) group by label) group by size""",
    "pagerank_topk": _BASE + _PR + "select id, name, round(rank, 6) as rank from top join nm using (id)",
    "node_detail": _BASE + _reach("art", "arts", "(select k as id from perm)") + _reach("cat", "nm", "(select k as id from perm)") + _BOTH + f"""
select nm.id, nm.name, coalesce(din.n, 0) as article_in, coalesce(dout.n, 0) as article_out, coalesce(cin.n, 0) as category_in, coalesce(cout.n, 0) as category_out,
  coalesce(array_to_string(ha.h, ','), '') as article_dist, coalesce(array_to_string(hc.h, ','), '') as category_dist, coalesce(list_max(ha.h), 0) as max_count
from perm join nm on nm.id = perm.k left join din on din.id = nm.id and nm.id in (select id from arts) left join dout on dout.id = nm.id left join cin on cin.id = nm.id left join cout on cout.id = nm.id
left join {_hist("art")} ha on ha.source = nm.id left join {_hist("cat")} hc on hc.source = nm.id""",
    "interesting_nodes": _BASE + _reach("art", "arts") + _reach("cat", "nm") + _SCC + _NEAR + _CNEAR + _PR + "select id, name from (select id from top union select source from central union select source from ccentral) join nm using (id)",
    "distance_totals_category": _BASE + _reach("cat", "nm") + _CNEAR + """select count(*) as nodes_done, cast(sum(distances) as bigint) as distance_sum, cast(sum(reachable) as bigint) as reachable_sum,
  count(*) filter (where reachable + 1 >= largest) as eligible, round(sum(distances) / sum(reachable), 6) as avg_distance, round(sum(reachable) / count(*), 6) as avg_reachable from cnear, cbig""",
    "sampling_coverage": _BASE + """select 'article' as graph, (select count(*) from perm where k in (select id from arts)) as nodes_done, count(*) as num_nodes,
  printf('%.1f', 100 * ((select count(*) from perm where k in (select id from arts)) / count(*))) as percent from arts
union all select 'category', (select count(*) from perm), n, printf('%.1f', 100 * ((select count(*) from perm) / n)) from cnt""",
    "rank_percent": _BASE + _PR + "select id, printf('%.3f', 100 * round(rank, 9)) as percent from top",
    "spectrum_shown": _BASE + _reach("art", "arts") + "select dist, count(*) as n from reach_art where dist < 20 group by dist",
    "histograms_shown": _BASE + _reach("art", "arts") + "select source, dist, count(*) as n from reach_art where dist < 10 group by source, dist",
    "components_largest_first": _BASE + _SCC + 'select row_number() over (order by size desc) as place, size, "count" from scc',
    "category_rank_job": _BASE + _CPR + """select 'cR' as job, '{"ranks":[' || string_agg('[' || printf('%.6f', round(rank, 9)) || ',' || id || ']', ',' order by round(rank, 9) desc, id desc) || ']}' as result from top""",
    "permutation_sample": _BASE + "select i, k from perm",
    "answer_log": "select concat('aD', o_custkey) as job, arg_min(o_orderstatus, o_orderkey) as result from orders group by o_custkey",
    "cache_missing_nodes": "select job from (select concat(c, c_custkey) as job from customer, (values ('aD'), ('aI')) t(c)) where job not in (select concat('aD', o_custkey) from orders)",
    "dump_scan": "select p_partkey as k, cast(null as varchar) as nothing, concat('it''s; (', p_name, ')') as name, p_brand as brand, -1500.0::double as x from part",
    "job_results": _BASE + _reach("art", "arts", "(select 5 as id)") + _reach("cat", "nm", "(select 5 as id)") + _SCC + _BOTH + f"""
, grow(a, b) as (select graph_id, graph_id from nodes union select g.a, c.dst from grow g join (select distinct src, dst from cat) c on c.src = g.b),
cc as (select size, count(*) as "count" from (select label, count(*) as size from (select a, min(b) as label from grow group by a) group by label) group by size)
select 'aD5' as job, '{{"count_dist":[' || array_to_string(h, ',') || ']}}' as result from {_hist("art")}
union all select 'cD5', '{{"count_dist":[' || array_to_string(h, ',') || ']}}' from {_hist("cat")}
union all select 'aI5', '{{"in_degree":' || coalesce((select n from din where id = 5), 0) || ',"out_degree":' || coalesce((select n from dout where id = 5), 0) || '}}'
union all select 'cI5', '{{"in_degree":' || coalesce((select n from cin where id = 5), 0) || ',"out_degree":' || coalesce((select n from cout where id = 5), 0) || '}}'
union all select 'aS', '{{"components":[' || string_agg('[' || size || ',' || "count" || ']', ',' order by size) || ']}}' from scc
union all select 'cS', '{{"components":[' || string_agg('[' || size || ',' || "count" || ']', ',' order by size) || ']}}' from cc
union all select j, '{{"error":"Node out of range"}}' from (values ('aD0'), ('aD999999999')) t(j)
union all select 'aD' || n, '{{"error":"Node is category"}}' from cnt
union all select 'xyz', '{{"error":"Unknown command"}}'""",
    "pagerank_job": _BASE + _PR + """select 'aR' as job, '{"ranks":[' || string_agg('[' || printf('%.6f', round(rank, 9)) || ',' || id || ']', ',' order by round(rank, 9) desc, id desc) || ']}' as result from top""",
}
