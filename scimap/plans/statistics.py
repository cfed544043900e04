"""Queries: agreement, concentration, laws, panels."""

from __future__ import annotations

from pyspark.sql import functions as F

from scimap.operators import agreement as ag
from scimap.operators import delphi, laws
from scimap.operators import frequency as fr
from scimap.plans import adapter as ad
from scimap.plans.adapter import with_
from scimap.plans.base import query
from scimap.sources.tables import table


def _gini(t: str) -> str:
    return f"(SELECT (n + 1 - 2 * cum / s) / n FROM (SELECT count(*) AS n, sum(x) AS s, sum((k + 1 - r) * x) AS cum FROM (SELECT n AS x, row_number() OVER (ORDER BY n) AS r, count(*) OVER () AS k FROM {t})))"


@query(f"""{with_("countries", "authors")}, c AS (SELECT item, count(*) AS n FROM countries GROUP BY 1), i AS (SELECT item, count(*) AS n FROM authors GROUP BY 1)
    SELECT 'country' AS kind, (SELECT count(*) FROM c) AS n, (SELECT round(sum(n * n) / pow(sum(n), 2), 8) FROM c) AS hhi, round({_gini("c")}, 8) AS gini
    UNION ALL SELECT 'institution', (SELECT count(*) FROM i), (SELECT round(sum(n * n) / pow(sum(n), 2), 8) FROM i), round({_gini("i")}, 8)""")
def stat_hhi_gini(spark, sf):
    c = laws.concentration(ad.countries(spark, sf), ad.authors(spark, sf))
    return c.select("kind", "n", F.round("hhi", 8).alias("hhi"), F.round("gini", 8).alias("gini"))


def _ari(source: str, by: str = "") -> str:
    group, comma = (f"GROUP BY {by}", f"{by},") if by else ("", "")
    on = f"USING ({by})" if by else "ON TRUE"
    return f"""cell AS (SELECT {comma} a, b, count(*) AS n FROM {source} GROUP BY {comma} a, b),
    s AS (SELECT {comma} sum(n) AS n, sum(n * (n - 1) / 2) AS hits FROM cell {group}),
    ra AS (SELECT {comma} sum(n * (n - 1) / 2) AS pa FROM (SELECT {comma} a, sum(n) AS n FROM cell GROUP BY {comma} a) {group}),
    rb AS (SELECT {comma} sum(n * (n - 1) / 2) AS pb FROM (SELECT {comma} b, sum(n) AS n FROM cell GROUP BY {comma} b) {group}),
    x AS (SELECT {comma} n, hits, pa, pb, pa * pb / (n * (n - 1) / 2) AS e FROM s JOIN ra {on} JOIN rb {on})
    SELECT {comma} CAST(n AS BIGINT) AS n, round((hits - e) / ((pa + pb) / 2 - e), 8) AS ari FROM x"""


@query(f"WITH l AS (SELECT o_orderpriority AS a, o_orderstatus AS b FROM orders), {_ari('l')}")
def stat_ari(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("a"), F.col("o_orderstatus").alias("b"))
    return ag.adjusted_rand(o).withColumn("ari", F.round("ari", 8))


MEMBERS = """m AS (SELECT variant, node, cluster FROM (SELECT 'base' AS variant, p_partkey AS node, CAST(p_size % 7 AS INTEGER) AS cluster FROM part WHERE p_partkey % 10 <> 0
    UNION ALL SELECT 'near', p_partkey, CAST((p_size + CAST(p_partkey % 9 = 0 AS INTEGER)) % 7 AS INTEGER) FROM part WHERE p_partkey % 11 <> 0
    UNION ALL SELECT 'far', p_partkey, CAST(p_partkey % 4 AS INTEGER) FROM part))"""


def _members(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("node"), "p_size")
    rows = F.array(
        F.when(F.col("node") % 10 != 0, F.struct(F.lit("base").alias("variant"), (F.col("p_size") % 7).cast("int").alias("cluster"))),
        F.when(F.col("node") % 11 != 0, F.struct(F.lit("near").alias("variant"), ((F.col("p_size") + (F.col("node") % 9 == 0).cast("int")) % 7).cast("int").alias("cluster"))),
        F.struct(F.lit("far").alias("variant"), (F.col("node") % 4).cast("int").alias("cluster")),
    )
    return p.select("node", F.inline(F.array_compact(rows)))


@query(f"""WITH {MEMBERS}, g AS (SELECT DISTINCT v.variant, n.node FROM (SELECT DISTINCT variant FROM m) v, (SELECT DISTINCT node FROM m) n),
    l AS (SELECT g.variant, coalesce(x.cluster, -1) AS a, coalesce(y.cluster, -1) AS b FROM g LEFT JOIN m x ON x.variant = 'base' AND x.node = g.node LEFT JOIN m y ON y.variant = g.variant AND y.node = g.node), {_ari("l", "variant")}""")
def stat_ari_baseline(spark, sf):
    return ag.against_baseline(_members(spark, sf), "base").withColumn("ari", F.round("ari", 8))


@query(f"""WITH {MEMBERS}, z AS (SELECT variant, cluster, count(*) AS n FROM m GROUP BY 1, 2),
    i AS (SELECT b.variant, a.cluster AS ca, b.cluster AS cb, count(*) AS k FROM m a JOIN m b ON a.node = b.node AND a.variant = 'base' AND b.variant <> 'base' GROUP BY 1, 2, 3),
    j AS (SELECT i.variant, ca, max(k / (x.n + y.n - k)) AS best FROM i JOIN z x ON x.variant = 'base' AND x.cluster = ca JOIN z y ON y.variant = i.variant AND y.cluster = cb GROUP BY 1, 2)
    SELECT v.variant, b.cluster, round(coalesce(best, 0), 8) AS best FROM (SELECT DISTINCT variant FROM m WHERE variant <> 'base') v CROSS JOIN (SELECT cluster FROM z WHERE variant = 'base') b LEFT JOIN j ON j.variant = v.variant AND j.ca = b.cluster""")
def stat_jaccard_stability(spark, sf):
    return ag.stability(_members(spark, sf), "base").withColumn("best", F.round("best", 8))


@query("""WITH a AS (SELECT DISTINCT p_type AS k, p_name AS m FROM part), b AS (SELECT DISTINCT p_brand AS k, p_name AS m FROM part)
    SELECT a.k AS a, b.k AS b, round(count(*) / ((SELECT count(*) FROM a x WHERE x.k = a.k) + (SELECT count(*) FROM b y WHERE y.k = b.k) - count(*)), 8) AS jaccard FROM a JOIN b USING (m) GROUP BY a.k, b.k""")
def set_jaccard(spark, sf):
    p = table(spark, sf, "part")
    rows = F.array(F.struct(F.lit("a").alias("side"), F.col("p_type").alias("key")), F.struct(F.lit("b").alias("side"), F.col("p_brand").alias("key")))
    return ag.jaccard(p.select(F.inline(rows), F.col("p_name").alias("member"))).withColumn("jaccard", F.round("jaccard", 8))


KENDALL = """p AS (SELECT {k} count(*) * (count(*) - 1) / 2 AS n0, count(*) AS n FROM xy {g}),
    tx AS (SELECT {k} sum(c * (c - 1) / 2) AS tx FROM (SELECT {k} x, count(*) AS c FROM xy GROUP BY {k} x) {g}), ty AS (SELECT {k} sum(c * (c - 1) / 2) AS ty FROM (SELECT {k} y, count(*) AS c FROM xy GROUP BY {k} y) {g}),
    c AS (SELECT {k} x, y, count(*) AS c FROM xy GROUP BY {k} x, y), d AS (SELECT {ka} sum(a.c * b.c * sign(b.x - a.x) * sign(b.y - a.y)) AS d FROM c a JOIN c b ON {on} (a.x < b.x OR a.x = b.x AND a.y < b.y) {ga})"""


@query(f"""{with_("docs")}, r AS (SELECT CASE WHEN year <= 1996 THEN 'early' WHEN year <= 1998 THEN 'middle' ELSE 'recent' END AS era, l_partkey AS ref, count(*) AS n FROM lineitem JOIN docs ON l_orderkey = doc_id GROUP BY 1, 2),
    e AS (SELECT DISTINCT era FROM r), q AS (SELECT a.era AS era_a, b.era AS era_b FROM e a, e b WHERE a.era < b.era),
    u AS (SELECT DISTINCT era_a, era_b, ref FROM q JOIN r ON era = era_a OR era = era_b),
    xy AS (SELECT u.era_a, u.era_b, coalesce(x.n, 0) AS x, coalesce(y.n, 0) AS y FROM u LEFT JOIN r x ON x.era = era_a AND x.ref = u.ref LEFT JOIN r y ON y.era = era_b AND y.ref = u.ref),
    {KENDALL.format(k="era_a, era_b,", g="GROUP BY era_a, era_b", ka="a.era_a, a.era_b,", on="a.era_a = b.era_a AND a.era_b = b.era_b AND", ga="GROUP BY a.era_a, a.era_b")}
    SELECT era_a, era_b, n, round(d / sqrt((n0 - tx) * (n0 - ty)), 8) AS tau FROM p JOIN tx USING (era_a, era_b) JOIN ty USING (era_a, era_b) JOIN d USING (era_a, era_b)""")
def stat_kendall_eras(spark, sf):
    y = ad.years(spark, sf)
    era = F.when(F.col("year") <= 1996, "early").when(F.col("year") <= 1998, "middle").otherwise("recent")
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("ref"))
    c = li.join(y, "doc_id").groupBy(era.alias("era"), "ref").agg(F.count(F.lit(1)).alias("n"))
    return ag.era_correlation(c).withColumn("tau", F.round("tau", 8))


@query("""WITH s AS (SELECT p_size AS x, p_partkey % 31 AS y FROM part),
    r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry FROM s)
    SELECT count(*) AS n, round(corr(rx, ry), 8) AS rho FROM r""")
def stat_spearman(spark, sf):
    return ag.spearman(table(spark, sf, "part").select(F.col("p_size").alias("x"), (F.col("p_partkey") % 31).alias("y"))).withColumn("rho", F.round("rho", 8))


@query("SELECT p_partkey, p_size, CAST(rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2 AS DOUBLE) AS place FROM part")
def win_avg_rank(spark, sf):
    return ag.mean_ranks(table(spark, sf, "part").select("p_partkey", "p_size"), "p_size", "place").select("p_partkey", "p_size", F.col("place").cast("double").alias("place"))


LOTKA = """c AS (SELECT o_custkey, count(*) AS k FROM orders GROUP BY 1), f AS (SELECT k, count(*) AS n FROM c GROUP BY 1)"""


@query(f"WITH {LOTKA} SELECT round(-regr_slope(ln(n), ln(k)), 6) AS alpha, round(exp(regr_intercept(ln(n), ln(k))), 4) AS c, round(regr_r2(ln(n), ln(k)), 6) AS r_squared, CAST(sum(n) AS BIGINT) AS n_items FROM f")
def stat_lotka(spark, sf):
    items = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").cast("string").alias("item"))
    x = laws.lotka(fr.productivity(items))
    return x.select(F.round("alpha", 6).alias("alpha"), F.round("c", 4).alias("c"), F.round("r_squared", 6).alias("r_squared"), "n_items")


@query(f"""{with_("docs")}, y AS (SELECT year, count(*) AS n FROM docs GROUP BY 1), s AS (SELECT CAST(year - min(year) OVER () AS DOUBLE) AS t, CAST(sum(n) OVER (ORDER BY year) AS DOUBLE) AS y FROM y),
    g AS (SELECT count(*) AS k, regr_slope(y, t) AS a, regr_intercept(y, t) AS b, regr_r2(y, t) AS r2, regr_syy(y, t) AS syy FROM s)
    SELECT round(a, 4) AS slope, round(b, 4) AS intercept, round(r2, 6) AS r_squared, round(k * ln(syy * (1 - r2) / k) + 6, 4) AS aic, round(k * ln(syy * (1 - r2) / k) + 3 * ln(k), 4) AS bic FROM g""")
def stat_growth_linear_aic(spark, sf):
    g = laws.linear_growth(fr.by_year(ad.years(spark, sf)))
    return g.select(*[F.round(c, 6 if c == "r_squared" else 4).alias(c) for c in ("slope", "intercept", "r_squared", "aic", "bic")])


@query()
def stat_growth_models(spark, sf):
    e = table(spark, sf, "events").groupBy(F.col("event_type").alias("corpus"), F.dayofyear("ts").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    return laws.growth_models(e).select("corpus", "model", F.round("r_squared", 4).alias("r_squared"), "best")


@query("""WITH p AS (SELECT quality = 1 AS a, toxic = 1 AS b FROM labels), g AS (SELECT count(*) AS n, avg(CAST(a = b AS INTEGER)) AS po, avg(CAST(a AS INTEGER)) AS pa, avg(CAST(b AS INTEGER)) AS pb FROM p)
    SELECT n, round((po - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))), 8) AS kappa FROM g""")
def stat_cohen_kappa(spark, sf):
    p = table(spark, sf, "labels").select((F.col("quality") == 1).alias("a"), (F.col("toxic") == 1).alias("b"))
    return ag.cohen_kappa(p).withColumn("kappa", F.round("kappa", 8))


RATINGS = "r AS (SELECT DISTINCT CAST(s_nationkey % 5 AS INTEGER) AS cluster, s_suppkey AS rater, CAST(i AS INTEGER) AS item, CAST(1 + (s_suppkey * 7 + i * i * 3 + s_nationkey * i) % 5 AS INTEGER) AS rating FROM supplier, (SELECT unnest(range(1, 11)) AS i))"


def _ratings(spark, sf):
    """Ratings 1 to 5 by all suppliers, made of their keys."""
    s = table(spark, sf, "supplier").withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(10))))
    rating = 1 + (F.col("s_suppkey") * 7 + F.col("i") * F.col("i") * 3 + F.col("s_nationkey") * F.col("i")) % 5
    return s.select((F.col("s_nationkey") % 5).cast("int").alias("cluster"), F.col("s_suppkey").alias("rater"), F.col("i").alias("item"), rating.cast("int").alias("rating"))


@query(f"""WITH {RATINGS}, i AS (SELECT cluster, item, count(*) AS m, sum(rating) AS s, sum(rating * rating) AS q FROM r GROUP BY 1, 2),
    g AS (SELECT cluster, sum(m * q - s * s) AS ins, sum(m * (m - 1) / 2) AS ip, sum(m) AS n, sum(s) AS s, sum(q) AS q FROM i GROUP BY 1)
    SELECT cluster, CAST(n AS BIGINT) AS n, round(1 - coalesce(ins / nullif(ip, 0), 0) / ((n * q - s * s) / (n * (n - 1) / 2)), 8) AS alpha FROM g""")
def stat_krippendorff(spark, sf):
    return ag.krippendorff(_ratings(spark, sf), ["cluster"]).withColumn("alpha", F.round("alpha", 8))


@query(f"""WITH {RATINGS}, p AS (SELECT a.cluster, a.rater AS ra, b.rater AS rb, a.rating >= 4 AS a, b.rating >= 4 AS b FROM r a JOIN r b ON a.cluster = b.cluster AND a.item = b.item AND a.rater < b.rater),
    g AS (SELECT cluster, ra, rb, avg(CAST(a = b AS INTEGER)) AS po, avg(CAST(a AS INTEGER)) AS pa, avg(CAST(b AS INTEGER)) AS pb FROM p GROUP BY 1, 2, 3),
    k AS (SELECT cluster, CASE WHEN pa * pb + (1 - pa) * (1 - pb) >= 1 THEN 1 ELSE (po - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))) END AS kappa FROM g)
    SELECT cluster, count(*) AS n_pairs, round(avg(kappa), 8) AS mean, round(min(kappa), 8) AS least, round(max(kappa), 8) AS most FROM k GROUP BY 1""")
def stat_kappa_pairs(spark, sf):
    k = delphi.kappa_summary(_ratings(spark, sf))
    return k.select("cluster", "n_pairs", *[F.round(c, 8).alias(c) for c in ("mean", "least", "most")])


@query(f"""WITH {RATINGS}, m AS (SELECT *, median(rating) OVER (PARTITION BY cluster, item) AS med FROM r)
    SELECT cluster, rater, item, CAST(CASE WHEN abs(rating - med) >= 2 AND (rater + item) % 10 < 3 THEN round_even((rating + med) / 2, 0) ELSE rating END AS INTEGER) AS rating FROM m""")
def delphi_revision(spark, sf):
    draw = ((F.col("rater") + F.col("item")) % 10) / 10
    return delphi.round_two(_ratings(spark, sf), draw, share=0.25).select("cluster", "rater", "item", "rating")


@query(f"""WITH {RATINGS}, x AS (SELECT cluster, rater, row_number() OVER (PARTITION BY cluster ORDER BY rater) - 1 AS seat, count(*) OVER (PARTITION BY cluster) AS n FROM (SELECT DISTINCT cluster, rater FROM r)),
    t AS (SELECT cluster, p AS replicate, CAST('0x' || substr(md5('42:' || cluster || ':' || p || ':' || seat), 1, 8) AS BIGINT) % n AS seat, count(*) AS k FROM x, (SELECT unnest(range(1, 301)) AS p) GROUP BY 1, 2, 3),
    w AS (SELECT cluster, replicate, rater, k FROM t JOIN x USING (cluster, seat) UNION ALL SELECT cluster, 0, rater, 1 FROM x),
    i AS (SELECT cluster, replicate, item, sum(k) AS m, sum(k * rating) AS s, sum(k * rating * rating) AS q FROM w JOIN r USING (cluster, rater) GROUP BY 1, 2, 3),
    g AS (SELECT cluster, replicate, sum(m * q - s * s) AS ins, sum(m * (m - 1) / 2) AS ip, sum(m) AS n, sum(s) AS s, sum(q) AS q FROM i GROUP BY 1, 2),
    a AS (SELECT cluster, replicate, CASE WHEN coalesce((n * q - s * s) / nullif(n * (n - 1) / 2, 0), 0) = 0 THEN 1 ELSE 1 - coalesce(ins / nullif(ip, 0), 0) / ((n * q - s * s) / (n * (n - 1) / 2)) END AS alpha FROM g)
    SELECT cluster, round(max(alpha) FILTER (replicate = 0), 6) AS alpha, round(quantile_cont(alpha, 0.025) FILTER (replicate > 0), 6) AS low, round(quantile_cont(alpha, 0.975) FILTER (replicate > 0), 6) AS high FROM a GROUP BY 1""")
def stat_bootstrap_alpha(spark, sf):
    a = delphi.bootstrap_alpha(_ratings(spark, sf))
    return a.select("cluster", *[F.round(c, 6).alias(c) for c in ("alpha", "low", "high")])


@query()
def delphi_simulation(spark, sf):
    """A simulated panel: all nations rate the regions."""
    n = table(spark, sf, "nation")
    panel = n.select(F.col("n_name").alias("rater"), (F.col("n_nationkey") * 3).alias("experience"))
    clusters = table(spark, sf, "region").select(F.col("r_name").alias("cluster"), (2.5 + F.col("r_regionkey") / 2).alias("consensus"))
    out = delphi.simulate(panel, clusters)
    rows = out["kappa"].join(out["alpha"], "cluster").join(out["decisions"], "cluster")
    return rows.select("cluster", "decision", "n_pairs", *[F.round(c, 6).alias(c) for c in ("mean", "least", "most", "alpha", "low", "high")])
