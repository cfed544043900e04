"""Queries: metrics of the graph of countries, communities of small graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from scimap.operators import communities as cm
from scimap.operators import cooccurrence as co
from scimap.operators import graphs as gr
from scimap.operators.ranks import running
from scimap.plans import adapter as ad
from scimap.plans import reports
from scimap.plans.adapter import COUPLED, GRAPH, with_
from scimap.plans.base import query
from scimap.sources.stores import spread
from scimap.sources.tables import table

G = with_(*GRAPH)
R = with_(*GRAPH, recursive=True)
D = with_(*COUPLED)
DEGREE = "deg AS (SELECT node, count(u) AS degree, CAST(coalesce(sum(weight), 0) AS BIGINT) AS strength FROM nodes LEFT JOIN two ON u = node GROUP BY 1)"
TRIANGLES = """tri AS (SELECT a.src AS a, a.dst AS b, b.dst AS c, a.weight AS wab, b.weight AS wbc, c.weight AS wac FROM edges a JOIN edges b ON a.dst = b.src JOIN edges c ON c.src = a.src AND c.dst = b.dst),
    corner AS (SELECT a AS node, wab, wbc, wac FROM tri UNION ALL SELECT b, wab, wbc, wac FROM tri UNION ALL SELECT c, wab, wbc, wac FROM tri)"""


@query(f"{D} SELECT n, m, round(2 * m / (n * (n - 1)), 6) AS density, round(2 * m / n, 6) AS mean_degree FROM (SELECT (SELECT count(*) FROM nodes) AS n, (SELECT count(*) FROM edges) AS m)")
def graph_density(spark, sf):
    d = gr.density(*ad.coupling_graph(spark, sf))
    return d.select("n", "m", F.round("density", 6).alias("density"), F.round("mean_degree", 6).alias("mean_degree"))


@query(f"{D}, {DEGREE} SELECT node, degree, strength, round(degree / ((SELECT count(*) FROM nodes) - 1), 6) AS centrality FROM deg")
def graph_degree_centrality(spark, sf):
    return gr.degrees(*ad.coupling_graph(spark, sf)).withColumn("centrality", F.round("centrality", 6))


@query(f"{D}, {DEGREE} SELECT node, CAST(rank() OVER (ORDER BY degree DESC) AS INTEGER) AS place FROM deg")
def win_centrality_rank(spark, sf):
    d = gr.degrees(*ad.coupling_graph(spark, sf)).select("node", "centrality")
    # equal values are one row in the ranges, so a rank is one more than the nodes that stand before them
    n = running(d.groupBy("centrality").agg(F.count(F.lit(1)).alias("n")), [F.col("centrality").desc()], "n")
    place = n.select("centrality", (F.col("running") - F.col("n") + 1).cast("int").alias("place"))
    return d.join(place, "centrality").select("node", "place")


@query(f"""{D}, {DEGREE}, {TRIANGLES}, t AS (SELECT node, count(*) AS t FROM corner GROUP BY 1)
    SELECT node, round(CASE WHEN degree >= 2 THEN 2 * coalesce(t, 0) / (degree * (degree - 1)) ELSE 0 END, 6) AS clustering FROM deg LEFT JOIN t USING (node)""")
def graph_clustering(spark, sf):
    return gr.clustering(*ad.coupling_graph(spark, sf)).withColumn("clustering", F.round("clustering", 6))


@query(f"""{D}, {DEGREE}, {TRIANGLES}, x AS (SELECT max(weight) AS w FROM edges), t AS (SELECT node, sum(cbrt(wab / w * wac / w * wbc / w)) AS t FROM corner, x GROUP BY 1)
    SELECT round(avg(CASE WHEN degree >= 2 THEN 2 * coalesce(t, 0) / (degree * (degree - 1)) ELSE 0 END), 6) AS clustering FROM deg LEFT JOIN t USING (node)""")
def graph_clustering_weighted(spark, sf):
    return gr.mean_clustering(*ad.coupling_graph(spark, sf), weighted=True).select(F.round("clustering", 6).alias("clustering"))


@query(f"""{with_(*COUPLED, recursive=True)}, reach AS (SELECT node AS s, node AS t FROM nodes UNION SELECT s, v FROM reach JOIN two ON t = u)
    SELECT s AS node, min(t) AS component FROM reach GROUP BY 1""")
def graph_components(spark, sf):
    return gr.components(*ad.coupling_graph(spark, sf))


@query(f"""{G}, e AS (SELECT weight, a.cluster AS ca, b.cluster AS cb FROM edges JOIN regions a ON a.node = src JOIN regions b ON b.node = dst), m AS (SELECT sum(weight) AS m FROM e),
    k AS (SELECT cluster, sum(w) AS inside, sum(d) AS degree FROM (SELECT ca AS cluster, CASE WHEN ca = cb THEN weight ELSE 0 END AS w, weight AS d FROM e UNION ALL SELECT cb, 0, weight FROM e) GROUP BY 1)
    SELECT round(sum(inside / m - pow(degree / (2 * m), 2)), 6) AS modularity FROM k, m""")
def graph_modularity(spark, sf):
    _, edges = ad.country_graph(spark, sf)
    return gr.modularity(edges, ad.regions(spark, sf)).select(F.round("modularity", 6).alias("modularity"))


#: Each pair's least number of edges: a pair that is there already is not met again.
HOP = """hop(s, t, d) USING KEY (s, t) AS (SELECT node, node, 0 FROM nodes UNION
        SELECT hop.s, v, hop.d + 1 FROM hop JOIN two ON hop.t = u LEFT JOIN recurring.hop AS r ON r.s = hop.s AND r.t = v WHERE r.s IS NULL), n AS (SELECT count(*) AS n FROM nodes)"""


@query(f"{R}, {HOP} SELECT CAST(CASE WHEN count(*) = any_value(n) * any_value(n) AND any_value(n) > 1 THEN max(d) END AS BIGINT) AS diameter FROM hop, n")
def graph_diameter(spark, sf):
    nodes, edges = ad.country_graph(spark, sf)
    return gr.diameter(nodes, gr.reach(nodes, edges))


@query(f"{with_(*COUPLED, recursive=True)}, {HOP} SELECT s AS node, round(CASE WHEN sum(d) > 0 THEN (count(*) - 1) / sum(d) * (count(*) - 1) / (any_value(n) - 1) ELSE 0 END, 6) AS closeness FROM hop, n GROUP BY 1")
def graph_closeness(spark, sf):
    nodes, edges = ad.coupling_graph(spark, sf)
    return gr.closeness(nodes, gr.reach(nodes, edges)).withColumn("closeness", F.round("closeness", 6))


@query(f"{with_(*COUPLED, recursive=True)}, {HOP}, c AS (SELECT s, min(t) AS component FROM hop GROUP BY 1) SELECT component, count(DISTINCT s) AS n, max(d) AS diameter, CAST(sum(d) // 2 AS BIGINT) AS distances FROM c JOIN hop USING (s) GROUP BY 1")
def graph_component_diameters(spark, sf):
    """Of each component: its nodes, its largest distance, and the sum of the distances of its pairs."""
    nodes, edges = ad.coupling_graph(spark, sf)
    r = gr.reach(nodes, edges).join(gr.components(nodes, edges), "node").groupBy("component")
    return r.agg(F.count(F.lit(1)).alias("n"), F.max("farthest").alias("diameter"), F.expr("sum(total) div 2").alias("distances"))


def _rank_rounds(k: int) -> str:
    """The chain of CTEs of k rounds of PageRank, beside n; all nodes have edges, so no rank is lost."""
    parts = ["o AS (SELECT u, sum(weight) AS w FROM two GROUP BY 1)", "r0 AS (SELECT node, 1 / n AS rank FROM nodes, n)"]
    for i in range(k):
        parts.append(f"r{i + 1} AS (SELECT v AS node, 0.85::DOUBLE * sum(rank * weight / w) + 0.15::DOUBLE / any_value(n) AS rank FROM r{i}, n, two, o WHERE r{i}.node = two.u AND two.u = o.u GROUP BY 1)")
    return ", ".join(parts)


@query(f"{D}, n AS (SELECT count(*) AS n FROM nodes), {_rank_rounds(10)} SELECT node, round(rank, 6) AS rank FROM r10")
def graph_pagerank_fixed_iters(spark, sf):
    return gr.pagerank(*ad.coupling_graph(spark, sf), rounds=10).withColumn("rank", F.round("rank", 6))


CALLON = f"""{G}, e AS (SELECT weight, a.cluster AS ca, b.cluster AS cb FROM edges JOIN regions a ON a.node = src JOIN regions b ON b.node = dst),
    k AS (SELECT cluster, sum(i) AS inside, sum(x) AS outside FROM (SELECT ca AS cluster, CASE WHEN ca = cb THEN weight ELSE 0 END AS i, CASE WHEN ca = cb THEN 0 ELSE weight END AS x FROM e UNION ALL SELECT cb, 0, CASE WHEN ca = cb THEN 0 ELSE weight END FROM e) GROUP BY 1),
    c AS (SELECT cluster, count(*) AS n, CAST(any_value(outside) AS DOUBLE) AS centrality, CAST(any_value(inside) AS DOUBLE) / count(*) AS density FROM nodes JOIN regions USING (node) JOIN k USING (cluster) GROUP BY 1)"""


@query(f"{CALLON} SELECT cluster, n, centrality, round(density, 6) AS density FROM c")
def graph_callon(spark, sf):
    return gr.callon(*ad.country_graph(spark, sf), ad.regions(spark, sf)).withColumn("density", F.round("density", 6))


@query(f"""{CALLON}, q AS (SELECT median(centrality) AS mc, median(density) AS md FROM c)
    SELECT cluster, CASE WHEN centrality >= mc AND density >= md THEN 'motor' WHEN centrality >= mc THEN 'basic_transversal' WHEN density >= md THEN 'niche' ELSE 'emerging_or_declining' END AS quadrant FROM c, q""")
def graph_quadrants(spark, sf):
    return gr.quadrants(gr.callon(*ad.country_graph(spark, sf), ad.regions(spark, sf))).select("cluster", "quadrant")


@query(f"{G} SELECT src, dst, weight FROM edges WHERE src IN (SELECT node FROM regions WHERE cluster < 3) AND dst IN (SELECT node FROM regions WHERE cluster < 3)")
def graph_build(spark, sf):
    """The edges, given twice and turned round, between the countries of three regions: the last weight counts."""
    _, e = ad.country_graph(spark, sf)
    twice = e.select("src", "dst", F.lit(-1).cast("long").alias("weight"), F.lit(0).alias("seq")).unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight", F.lit(1).alias("seq")))
    return gr.build(ad.regions(spark, sf).where("cluster < 3").select("node"), twice)


def _named(spark, sf):
    return ad.country_graph(spark, sf)[1].withColumn("graph", F.lit("countries"))


def _power_rounds(k: int) -> str:
    """The chain of CTEs of k rounds of the power iteration on the weights plus the identity."""
    parts = ["x0 AS (SELECT node, 1.0::DOUBLE / count(*) OVER () AS x FROM nodes)"]
    for i in range(k):
        parts.append(f"y{i} AS (SELECT a.node, any_value(a.x) + coalesce(sum(b.x * weight), 0) AS y FROM x{i} a LEFT JOIN two ON v = a.node LEFT JOIN x{i} b ON b.node = u GROUP BY 1)")
        parts.append(f"x{i + 1} AS (SELECT node, y / sqrt(sum(y * y) OVER ()) AS x FROM y{i})")
    return ", ".join(parts)


@query(f"{G}, {_power_rounds(12)} SELECT node, round(x, 5) AS centrality FROM x12")
def graph_eigenvector(spark, sf):
    """It settles within 12 rounds: countries are linked by weights much above 1, and nearly alike."""
    return gr.eigenvector(*ad.country_graph(spark, sf)).withColumn("centrality", F.round("centrality", 5))


#: Distances by rounds of longer walks, then numbers of shortest paths by rounds of edges that lie on one.
BETWEEN = """far AS (SELECT node AS s, node AS t, 0 AS d, 0 AS h FROM nodes UNION ALL SELECT s, v, CAST(min(d + weight) AS INTEGER), h + 1 FROM far JOIN two ON t = u WHERE h < 24 GROUP BY s, v, h),
    dist AS (SELECT s, t, min(d) AS d FROM far GROUP BY 1, 2),
    tight AS (SELECT x.s, u, v FROM dist x JOIN two ON x.t = u JOIN dist y ON y.s = x.s AND y.t = v WHERE y.d = x.d + weight),
    step AS (SELECT node AS s, node AS t, 1::DOUBLE AS k FROM nodes UNION ALL SELECT step.s, v, sum(k) FROM step JOIN tight ON tight.s = step.s AND u = t GROUP BY step.s, v),
    ways AS (SELECT s, t, d, sum(k) AS k FROM step JOIN dist USING (s, t) GROUP BY 1, 2, 3),
    past AS (SELECT a.t AS node, sum(a.k * z.k / w.k) AS b FROM ways a JOIN ways z ON z.s = a.t JOIN ways w ON w.s = a.s AND w.t = z.t WHERE a.d + z.d = w.d AND a.s <> a.t AND z.s <> z.t GROUP BY 1),
    btw AS (SELECT node, coalesce(b, 0) / ((SELECT count(*) FROM nodes) - 1) / ((SELECT count(*) FROM nodes) - 2) AS betweenness FROM nodes LEFT JOIN past USING (node))"""


@query(f"{R}, {BETWEEN} SELECT 'countries' AS graph, node, round(betweenness, 6) AS betweenness FROM btw")
def graph_betweenness(spark, sf):
    return cm.betweenness(_named(spark, sf)).withColumn("betweenness", F.round("betweenness", 6))


@query()
def graph_louvain(spark, sf):
    return cm.communities(_named(spark, sf), "louvain")


@query()
def graph_leiden(spark, sf):
    return cm.communities(_named(spark, sf), "leiden")


@query()
def graph_greedy(spark, sf):
    return cm.communities(_named(spark, sf), "greedy")


@query()
def graph_lpa(spark, sf):
    return cm.communities(_named(spark, sf), "label_propagation")


@query()
def graph_map_equation(spark, sf):
    return cm.communities(_named(spark, sf), "map_equation")


@query()
def graph_resolution_sweep(spark, sf):
    return cm.sweep(_named(spark, sf))


@query()
def stat_bootstrap_stability(spark, sf):
    s = cm.stability_summary(cm.bootstrap_stability(_named(spark, sf)))
    return s.select("graph", "n", *[F.round(c, 6).alias(c) for c in ("mean", "sd", "low", "high")])


@query()
def graph_era_keywords(spark, sf):
    """Louvain on each year's keyword graph, the years' graphs in parallel; a keyword's node is its first word's pair."""
    p, li = table(spark, sf, "part"), table(spark, sf, "lineitem")
    k = li.join(p, li["l_partkey"] == p["p_partkey"]).join(ad.years(spark, sf), li["l_orderkey"] == F.col("doc_id"))
    e = co.pairs(k.select(F.col("year").cast("string").alias("graph"), "doc_id", F.col("p_brand").alias("item")), by=("graph",))
    return cm.communities(e, "louvain")


@query(f"""WITH d AS (SELECT o_orderkey AS doc_id, year(o_orderdate) AS year FROM orders), r AS (SELECT DISTINCT year, l_orderkey AS doc_id, l_suppkey AS ref FROM lineitem JOIN d ON l_orderkey = doc_id),
    y AS (SELECT CAST(year AS INTEGER) AS year, count(DISTINCT doc_id) AS n, count(DISTINCT ref) AS n_refs FROM r GROUP BY 1) SELECT * FROM y""")
def graph_era_sizes(spark, sf):
    li = table(spark, sf, "lineitem")
    r = li.join(ad.years(spark, sf), li["l_orderkey"] == F.col("doc_id")).select("year", "doc_id", F.col("l_suppkey").alias("ref")).distinct()
    return r.groupBy("year").agg(F.countDistinct("doc_id").alias("n"), F.countDistinct("ref").alias("n_refs"))


def keyword_graph(items, min_docs: int = 3):
    """Nodes and edges of items in at least min_docs documents."""
    return co.nodes_of(items, min_docs), co.pairs(items, min_docs)


@query(f"""{R}, {HOP}, {DEGREE}, {TRIANGLES}, t AS (SELECT node, count(*) AS t FROM corner GROUP BY 1),
    cl AS (SELECT avg(CASE WHEN degree >= 2 THEN 2 * coalesce(t, 0) / (degree * (degree - 1)) ELSE 0 END) AS c FROM deg LEFT JOIN t USING (node)),
    co AS (SELECT count(DISTINCT component) AS k FROM (SELECT s, min(t) AS component FROM hop GROUP BY 1)),
    di AS (SELECT CASE WHEN count(*) = any_value(n) * any_value(n) AND any_value(n) > 1 THEN max(d) END AS d FROM hop, n),
    e AS (SELECT weight, a.cluster AS ca, b.cluster AS cb FROM edges JOIN regions a ON a.node = src JOIN regions b ON b.node = dst), m AS (SELECT sum(weight) AS m, count(*) AS k FROM e),
    g AS (SELECT cluster, sum(w) AS inside, sum(d) AS degree FROM (SELECT ca AS cluster, CASE WHEN ca = cb THEN weight ELSE 0 END AS w, weight AS d FROM e UNION ALL SELECT cb, 0, weight FROM e) GROUP BY 1),
    q AS (SELECT sum(inside / m - pow(degree / (2 * m), 2)) AS q FROM g, m)
    SELECT n, m.k AS m, round(2 * m.k / (n * (n - 1)), 6) AS density, round(2 * m.k / n, 6) AS mean_degree, round(c, 6) AS clustering, co.k AS components, round(q, 6) AS modularity, CAST(d AS BIGINT) AS diameter FROM n, m, cl, co, q, di""")
def graph_network_metrics(spark, sf):
    nodes, edges = ad.country_graph(spark, sf)
    m = gr.network_metrics(nodes, edges, ad.regions(spark, sf))
    return m.select("n", "m", *[F.round(c, 6).alias(c) for c in ("density", "mean_degree", "clustering")], "components", F.round("modularity", 6).alias("modularity"), "diameter")


@query(f"""{R}, {HOP}, {DEGREE}, {BETWEEN}, {_power_rounds(12)}, {_rank_rounds(20)},
    cl AS (SELECT s AS node, CASE WHEN sum(d) > 0 THEN (count(*) - 1) / sum(d) * (count(*) - 1) / (any_value(n) - 1) ELSE 0 END AS closeness FROM hop, n GROUP BY 1)
    SELECT node, degree, round(degree / (n - 1), 5) AS centrality, round(betweenness, 5) AS betweenness, round(closeness, 5) AS closeness, round(x, 5) AS eigenvector, round(rank, 5) AS rank
    FROM deg JOIN btw USING (node) JOIN cl USING (node) JOIN x12 USING (node) JOIN r20 USING (node), n""")
def graph_node_metrics(spark, sf):
    """Centralities settle within 12 and 20 rounds."""
    nodes, edges = ad.country_graph(spark, sf)
    m = cm.node_metrics(nodes, edges)
    return m.select("node", "degree", *[F.round(c, 5).alias(c) for c in ("centrality", "betweenness", "closeness", "eigenvector", "rank")])


@query(f"""{with_("keywords")}, k AS (SELECT item AS node, count(*) AS n FROM keywords GROUP BY 1 HAVING count(*) >= 3),
    p AS (SELECT a.item AS src, b.item AS dst, count(*) AS weight FROM keywords a JOIN keywords b ON a.doc_id = b.doc_id AND a.item < b.item WHERE a.item IN (SELECT node FROM k) AND b.item IN (SELECT node FROM k) GROUP BY 1, 2)
    SELECT node, n, count(weight) AS degree, CAST(coalesce(sum(weight), 0) AS BIGINT) AS strength FROM k LEFT JOIN p ON node = src OR node = dst GROUP BY 1, 2""")
def graph_keyword_network(spark, sf):
    nodes, edges = keyword_graph(ad.keywords(spark, sf), 3)
    return nodes.join(gr.degrees(nodes.select("node"), edges).drop("centrality"), "node")


@query(f"""WITH d AS (SELECT o_orderkey AS doc_id, CAST(year(o_orderdate) AS INTEGER) AS era FROM orders),
    r AS (SELECT DISTINCT era, l_orderkey AS doc_id, l_partkey AS ref FROM lineitem JOIN d ON l_orderkey = doc_id),
    n AS (SELECT era, count(*) AS n FROM d GROUP BY 1), p AS (SELECT a.era, a.doc_id AS x, b.doc_id AS y FROM r a JOIN r b ON a.era = b.era AND a.ref = b.ref AND a.doc_id < b.doc_id GROUP BY 1, 2, 3),
    m AS (SELECT era, count(*) AS m FROM p GROUP BY 1)
    SELECT era, n, coalesce(m, 0) AS m, round(2 * coalesce(m, 0) / (n * (n - 1)), 10) AS density FROM n LEFT JOIN m USING (era)""")
def graph_era_coupling(spark, sf):
    """Each year's coupling graph: documents, coupled pairs and density, all years in one grouped pass."""
    y = ad.years(spark, sf).withColumnRenamed("year", "era")
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("ref"))
    refs = spread(li, "doc_id").join(y, "doc_id")
    return reports.era_sizes(y, refs).withColumn("density", F.round("density", 10))
