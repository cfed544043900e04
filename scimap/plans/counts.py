"""Queries: frequencies, co-occurrence, windows, top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from scimap.operators import cooccurrence as co
from scimap.operators import frequency as fr
from scimap.operators import laws, trends
from scimap.plans import adapter as ad
from scimap.plans.adapter import with_
from scimap.plans.base import query
from scimap.sources.tables import table


@query(f"""{with_("keywords")} SELECT a.item AS src, b.item AS dst, count(*) AS weight
    FROM keywords a JOIN keywords b ON a.doc_id = b.doc_id AND a.item < b.item
    WHERE a.item IN (SELECT item FROM keywords GROUP BY 1 HAVING count(*) >= 3) AND b.item IN (SELECT item FROM keywords GROUP BY 1 HAVING count(*) >= 3)
    GROUP BY 1, 2""")
def join_keyword_cooccurrence(spark, sf):
    return co.pairs(ad.keywords(spark, sf), 3)


@query(f"""{with_("docs", "authors", "countries")} SELECT count(*) AS n_documents, min(year) AS first_year, max(year) AS last_year, CAST(sum(cited_by) AS BIGINT) AS citations, avg(cited_by) AS mean_citations,
    (SELECT count(DISTINCT item) FROM authors) AS n_authors, (SELECT count(DISTINCT source) FROM docs) AS n_sources, (SELECT count(DISTINCT item) FROM countries) AS n_countries FROM docs""")
def agg_basic_stats(spark, sf):
    return fr.basic_stats(ad.docs(spark, sf), ad.authors(spark, sf), ad.countries(spark, sf))


@query(f"{with_('docs')} SELECT year, count(*) AS n FROM docs GROUP BY 1")
def agg_pubs_by_year(spark, sf):
    return fr.by_year(ad.years(spark, sf))


@query(f"""{with_("docs", "authors")} SELECT item, count(*) AS n, CAST(sum(cited_by) AS BIGINT) AS citations FROM authors JOIN docs USING (doc_id) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""")
def agg_top_authors(spark, sf):
    return fr.top(fr.author_totals(ad.docs(spark, sf), ad.authors(spark, sf)), 20, F.col("n").desc(), F.col("item"))


@query(f"""{with_("docs")} SELECT source, count(title) AS n, CAST(sum(cited_by) AS BIGINT) AS citations FROM docs GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""")
def agg_top_sources(spark, sf):
    return fr.top(fr.source_totals(ad.docs(spark, sf)), 20, F.col("n").desc(), F.col("source"))


@query(f"{with_('keywords')} SELECT item, count(*) AS n FROM keywords GROUP BY 1")
def agg_keyword_freq(spark, sf):
    return fr.document_frequency(ad.keywords(spark, sf))


@query(f"{with_('refs')} SELECT n AS n_items, count(*) AS n FROM (SELECT ref, count(*) AS n FROM refs GROUP BY 1) GROUP BY 1")
def agg_productivity_dist(spark, sf):
    return fr.productivity(ad.references(spark, sf).withColumn("item", F.col("ref").cast("string")))


@query("""SELECT p_type AS canonical, count(DISTINCT p_brand) AS n_variants, string_agg(DISTINCT p_brand, '|' ORDER BY p_brand) AS variants FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1 ORDER BY 2 DESC, 1 LIMIT 15""")
def agg_variant_merges(spark, sf):
    return fr.variant_merges(table(spark, sf, "part").select(F.col("p_brand").alias("raw"), F.col("p_type").alias("canonical")))


@query(f"""{with_("docs", "refs")}, c AS (SELECT year AS era, ref, count(*) AS n FROM refs JOIN docs USING (doc_id) GROUP BY 1, 2)
    SELECT era, ref, n, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY era ORDER BY n DESC, ref) AS INTEGER) AS rank FROM c) WHERE rank <= 10""")
def agg_era_references(spark, sf):
    r = ad.references(spark, sf).join(ad.years(spark, sf), "doc_id").select(F.col("year").alias("era"), "ref")
    return co.top_references(r, 10)


@query("""SELECT o_orderpriority AS item, count(*) AS n, median(x) AS median, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr, avg(CAST(x >= 4 AS INTEGER)) AS agreement
    FROM (SELECT *, 1 + o_orderkey * 7 % 5 + o_custkey % 2 AS x FROM orders) GROUP BY 1""")
def agg_item_stats(spark, sf):
    o = table(spark, sf, "orders")
    return fr.item_stats(o.select(F.col("o_orderpriority").alias("item"), (1 + F.col("o_orderkey") * 7 % 5 + F.col("o_custkey") % 2).alias("rating")))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_size DESC, p_name, p_partkey) AS i FROM (SELECT *, p_size + p_partkey * 100 AS occ FROM part)),
    t AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY occ DESC) AS k FROM r)
    SELECT p_type AS cluster, count(*) AS n, CAST(sum(occ) AS BIGINT) AS occurrences, round(avg(CASE WHEN p_partkey % 3 <> 0 THEN 2000 + p_partkey % 20 END), 6) AS mean_year,
    string_agg(p_name, '|' ORDER BY occ DESC) FILTER (k <= 5) AS top_labels FROM t GROUP BY 1""")
def agg_cluster_summary(spark, sf):
    p = table(spark, sf, "part")
    year = F.when(F.col("p_partkey") % 3 != 0, 2000 + F.col("p_partkey") % 20).otherwise(0)
    n = p.select(F.col("p_type").alias("cluster"), F.col("p_name").alias("label"), (F.col("p_size") + F.col("p_partkey") * 100).alias("occurrences"), year.alias("year"))
    return fr.cluster_summary(n).withColumn("mean_year", F.round("mean_year", 6))


@query(f"{with_('docs')}, y AS (SELECT year, count(*) AS n FROM docs GROUP BY 1) SELECT year, n, CAST(sum(n) OVER (ORDER BY year) AS BIGINT) AS total FROM y")
def win_cumulative(spark, sf):
    return fr.cumulative(fr.by_year(ad.years(spark, sf)))


def _keyword_years(spark, sf):
    return ad.keywords(spark, sf).join(ad.years(spark, sf), "doc_id")


ITEM_YEARS = f"""{with_("docs", "keywords")}, c AS (SELECT item, year, count(*) AS n FROM keywords JOIN docs USING (doc_id) GROUP BY 1, 2),
    best AS (SELECT item FROM c GROUP BY 1 ORDER BY sum(n) DESC, item LIMIT 25),
    years AS (SELECT DISTINCT year FROM c),
    m AS (SELECT item, year, coalesce(n, 0) AS n FROM best CROSS JOIN years LEFT JOIN c USING (item, year))"""


@query(f"{ITEM_YEARS} SELECT * FROM m")
def agg_keyword_years(spark, sf):
    return trends.item_years(_keyword_years(spark, sf))


@query(f"""{ITEM_YEARS}, b AS (SELECT year, row_number() OVER (ORDER BY year DESC) AS back, count(*) OVER () AS k FROM years),
    g AS (SELECT item, CAST(sum(CASE WHEN back <= 3 THEN n ELSE 0 END) AS BIGINT) AS recent, CAST(sum(CASE WHEN back BETWEEN 4 AND 6 AND k >= 6 THEN n ELSE 0 END) AS BIGINT) AS prior FROM m JOIN b USING (year) GROUP BY 1)
    SELECT item, recent, prior, round((recent - prior) / greatest(prior, 1), 6) AS emergence_index FROM g""")
def win_emergence(spark, sf):
    return trends.emergence(trends.item_years(_keyword_years(spark, sf))).withColumn("emergence_index", F.round("emergence_index", 6))


@query(f"{with_('docs')}, y AS (SELECT year, count(*) AS n FROM docs GROUP BY 1) SELECT round(regr_slope(n, year), 6) AS slope, round(regr_intercept(n, year), 4) AS intercept FROM y")
def stat_linear_trend(spark, sf):
    return trends.linear_trend(fr.by_year(ad.years(spark, sf))).select(F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"))


BRADFORD = f"""{with_("docs")}, s AS (SELECT source AS item, count(*) AS n FROM docs GROUP BY 1),
    r AS (SELECT item, n, row_number() OVER (ORDER BY n DESC, item) AS i, sum(n) OVER (ORDER BY n DESC, item ROWS UNBOUNDED PRECEDING) AS running, sum(n) OVER () AS total FROM s),
    f AS (SELECT min(CASE WHEN running >= total / 3.0::DOUBLE * 1 THEN i END) AS f1, min(CASE WHEN running >= total / 3.0::DOUBLE * 2 THEN i END) AS f2 FROM r),
    z AS (SELECT item, n, i, running, total, 1 + CAST(i > f1 AS INTEGER) + CAST(i > greatest(f1 + 1, f2) AS INTEGER) AS zone FROM r, f)"""


def _zones(spark, sf):
    return laws.bradford_zones(fr.frequency(ad.sources(spark, sf)))


@query(f"{BRADFORD} SELECT item, n, CAST(i AS INTEGER) AS i, CAST(running AS BIGINT) AS running, CAST(total AS BIGINT) AS total, CAST(zone AS INTEGER) AS zone FROM z")
def win_bradford_zones(spark, sf):
    return _zones(spark, sf).withColumn("i", F.col("i").cast("int"))


@query(f"{BRADFORD}, g AS (SELECT zone, count(*) AS n FROM z GROUP BY 1), q AS (SELECT lead(n) OVER (ORDER BY zone) / n AS ratio FROM g) SELECT round(exp(avg(ln(ratio))), 6) AS k FROM q WHERE ratio IS NOT NULL")
def stat_bradford_k(spark, sf):
    return laws.bradford_multiplier(laws.bradford_summary(_zones(spark, sf))).select(F.round("k", 6).alias("k"))


@query(f"{BRADFORD} SELECT item, round(i / count(*) OVER (), 6) AS source_share, round(running / total, 6) AS document_share FROM z")
def win_concentration_curve(spark, sf):
    c = laws.concentration_curve(fr.frequency(ad.sources(spark, sf)))
    return c.select("item", F.round("source_share", 6).alias("source_share"), F.round("document_share", 6).alias("document_share"))


@query(f"""{with_("refs")} , r AS (SELECT * FROM refs WHERE ref IN (SELECT ref FROM refs GROUP BY 1 HAVING count(*) > 1))
    SELECT a.doc_id AS src, b.doc_id AS dst, count(*) AS weight FROM r a JOIN r b ON a.ref = b.ref AND a.doc_id < b.doc_id GROUP BY 1, 2 HAVING count(*) >= 2""")
def join_coupling(spark, sf):
    return co.coupling(ad.references(spark, sf), 2)


@query(f"{with_('countries', 'edges')} SELECT * FROM edges")
def join_collaboration(spark, sf):
    return co.collaboration(ad.countries(spark, sf))


def _flow_sql(left: str, right: str) -> str:
    best = lambda t: f"(SELECT item FROM {t} GROUP BY 1 ORDER BY count(*) DESC, item LIMIT 10)"
    return f"""SELECT a.item AS left_item, b.item AS right_item, count(*) AS weight FROM {left} a JOIN {right} b ON a.doc_id = b.doc_id
        WHERE a.item IN {best(left)} AND b.item IN {best(right)} GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 60"""


@query(f"{with_('docs', 'keywords')}, sources AS (SELECT doc_id, source AS item FROM docs) {_flow_sql('sources', 'keywords')}")
def join_three_field_source(spark, sf):
    return co.flows(ad.sources(spark, sf), ad.keywords(spark, sf))


@query(f"{with_('authors', 'keywords')} {_flow_sql('authors', 'keywords')}")
def join_three_field_author(spark, sf):
    return co.flows(ad.authors(spark, sf), ad.keywords(spark, sf))


@query(f"""{with_("countries")}, f AS (SELECT doc_id, min(item) AS country FROM countries GROUP BY 1)
    SELECT o_orderpriority AS cluster, country, count(*) AS n FROM orders JOIN f ON o_orderkey = doc_id GROUP BY 1, 2""")
def join_cluster_overlay(spark, sf):
    a = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderpriority").alias("cluster"))
    return co.cluster_overlay(a, ad.countries(spark, sf).withColumn("pos", F.lit(0)))


@query(f"""{with_("countries", "edges")} SELECT CASE WHEN src = 'NATION_7' THEN dst ELSE src END AS neighbour, weight FROM edges WHERE src = 'NATION_7' OR dst = 'NATION_7' ORDER BY 2 DESC, 1 LIMIT 8""")
def top_neighbours(spark, sf):
    return co.neighbours(co.collaboration(ad.countries(spark, sf)), "NATION_7")


@query(f"""{with_("authors")}, f AS (SELECT item, count(*) AS n, min(doc_id) AS first FROM authors GROUP BY 1)
    SELECT item, n FROM (SELECT *, row_number() OVER (ORDER BY n DESC, first, item) AS r FROM f) WHERE r <= 12""")
def top_first_seen(spark, sf):
    a = ad.authors(spark, sf)
    return fr.top_first_seen(a.withColumn("pos", F.col("item")), 12)


@query(f"""{with_("docs")} SELECT c.corpus, count(*) AS n, count(DISTINCT source) AS n_sources, round(avg(cited_by), 6) AS mean_citations
    FROM docs JOIN (SELECT * FROM (VALUES ('capped', 1999), ('all', 9999)) t(corpus, cap)) c ON year <= cap GROUP BY 1""")
def join_two_corpora(spark, sf):
    """Two corpora side by side in one grouped pass: all documents, and those up to a year."""
    d = ad.docs(spark, sf)
    both = d.withColumn("corpus", F.explode(F.array_compact(F.array(F.lit("all"), F.when(F.col("year") <= 1999, "capped")))))
    return both.groupBy("corpus").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("n_sources"), F.round(F.avg("cited_by"), 6).alias("mean_citations"))
