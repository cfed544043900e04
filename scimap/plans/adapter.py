"""The sales tables read as a bibliography: orders are documents, suppliers authors, parts keywords and references.

Each function gives a DataFrame; CTE has the same as SQL, for the counterparts of queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scimap.operators.cooccurrence import collaboration, coupling
from scimap.operators.graphs import endpoints
from scimap.sources.stores import checkpointed, spread
from scimap.sources.tables import table


def docs(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, year, source, segment, title, cited_by."""
    o, c, li = (table(spark, sf, t) for t in ("orders", "customer", "lineitem"))
    q = li.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.sum("l_quantity").alias("q"))
    d = o.join(c, o["o_custkey"] == c["c_custkey"]).select(
        F.col("o_orderkey").alias("doc_id"), F.year("o_orderdate").alias("year"), F.col("c_name").alias("source"), F.col("c_mktsegment").alias("segment"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title")
    )
    return d.join(q, "doc_id", "left").select("doc_id", "year", "source", "segment", "title", F.coalesce("q", F.lit(0)).cast("long").alias("cited_by"))


def years(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, year: without the joins that a source and citations need."""
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.year("o_orderdate").alias("year"))


def sources(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, item: the customer's name."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).select(F.col("o_orderkey").alias("doc_id"), F.col("c_name").alias("item"))


def authors(spark: SparkSession, sf: str) -> DataFrame:
    li, s = table(spark, sf, "lineitem"), table(spark, sf, "supplier")
    rows = li.join(s, li["l_suppkey"] == s["s_suppkey"]).select(F.col("l_orderkey").alias("doc_id"), F.col("s_name").alias("item"))
    return spread(rows, "doc_id").distinct()


def countries(spark: SparkSession, sf: str) -> DataFrame:
    li, s, n = (table(spark, sf, t) for t in ("lineitem", "supplier", "nation"))
    where = s.join(n, s["s_nationkey"] == n["n_nationkey"]).select("s_suppkey", F.col("n_name").alias("item"))
    return li.join(where, li["l_suppkey"] == where["s_suppkey"]).select(F.col("l_orderkey").alias("doc_id"), "item").distinct()


def keywords(spark: SparkSession, sf: str) -> DataFrame:
    li, p = table(spark, sf, "lineitem"), table(spark, sf, "part")
    return li.join(p, li["l_partkey"] == p["p_partkey"]).select(F.col("l_orderkey").alias("doc_id"), F.col("p_name").alias("item")).distinct()


def references(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("ref")).distinct()


def messages(spark: SparkSession, sf: str) -> DataFrame:
    """date, seq, speaker, ts, content, is_advisor of the conversations; a turn takes 37 seconds."""
    seconds = F.col("turn") * 37
    clock = F.concat_ws(":", F.lpad((F.floor(seconds / 3600) % 24).cast("string"), 2, "0"), F.lpad((F.floor(seconds / 60) % 60).cast("string"), 2, "0"), F.lpad((seconds % 60).cast("string"), 2, "0"))
    c = table(spark, sf, "conversations")
    return c.select(F.col("conv_id").alias("date"), F.col("turn").alias("seq"), F.col("role").alias("speaker"), clock.alias("ts"), F.col("text").alias("content"), (F.col("role") == "assistant").alias("is_advisor"))


def country_graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the countries that are in a document together."""
    e = checkpointed(collaboration(countries(spark, sf)))
    return endpoints(e), e


def coupling_graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the documents that share two references or more."""
    e = checkpointed(coupling(references(spark, sf), 2))
    return endpoints(e), e


def regions(spark: SparkSession, sf: str) -> DataFrame:
    """node, cluster: a country's region."""
    return table(spark, sf, "nation").select(F.col("n_name").alias("node"), F.col("n_regionkey").alias("cluster"))


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    """The documents with the delimited columns of an export; in every third document keywords are plurals, in every third upper case."""
    li, s, n, p = (table(spark, sf, t) for t in ("lineitem", "supplier", "nation", "part"))
    rows = li.join(s, li["l_suppkey"] == s["s_suppkey"]).join(n, s["s_nationkey"] == n["n_nationkey"]).join(p, li["l_partkey"] == p["p_partkey"])
    institute = F.concat(F.lit("Institute "), (F.col("s_suppkey") % 20).cast("string"))
    form = F.when(F.col("l_orderkey") % 3 == 1, F.concat("p_name", F.lit("s"))).when(F.col("l_orderkey") % 3 == 2, F.upper("p_name")).otherwise(F.col("p_name"))
    fields = {
        "authors_raw": F.col("s_name"),
        "keywords_raw": form,
        "affiliations_raw": F.concat_ws(", ", institute, "n_name"),
        "authors_affiliations_raw": F.concat_ws(", ", "s_name", F.lit("S."), institute, F.lit("City"), "n_name"),
        "references_raw": F.concat(F.lit("Part"), F.col("p_partkey").cast("string"), F.lit(" A., Title ("), (1980 + F.col("p_partkey") % 30).cast("string"), F.lit(")")),
    }
    lists = spread(rows, "l_orderkey").groupBy(F.col("l_orderkey").alias("doc_id")).agg(*[F.array_join(F.sort_array(F.collect_set(c)), "; ").alias(k) for k, c in fields.items()])
    d = docs(spark, sf).drop("segment").join(lists, "doc_id", "left")
    return d.withColumns({c: F.lit(None).cast("string") for c in ("index_keywords_raw", "abstract")})


CTE = {
    "docs": """docs AS (SELECT o_orderkey AS doc_id, CAST(year(o_orderdate) AS INTEGER) AS year, c_name AS source, c_mktsegment AS segment, 'Order ' || o_orderkey AS title, CAST(coalesce(q, 0) AS BIGINT) AS cited_by
        FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)""",
    "authors": "authors AS (SELECT DISTINCT l_orderkey AS doc_id, s_name AS item FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)",
    "countries": "countries AS (SELECT DISTINCT l_orderkey AS doc_id, n_name AS item FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)",
    "keywords": "keywords AS (SELECT DISTINCT l_orderkey AS doc_id, p_name AS item FROM lineitem JOIN part ON l_partkey = p_partkey)",
    "refs": "refs AS (SELECT DISTINCT l_orderkey AS doc_id, l_partkey AS ref FROM lineitem)",
    "messages": "messages AS (SELECT conv_id AS date, turn AS seq, role AS speaker, turn * 37 AS secs, text AS content, role = 'assistant' AS is_advisor FROM conversations)",
    "edges": "edges AS (SELECT a.item AS src, b.item AS dst, count(*) AS weight FROM countries a JOIN countries b ON a.doc_id = b.doc_id AND a.item < b.item GROUP BY 1, 2)",
    "coupled": "edges AS (SELECT a.doc_id AS src, b.doc_id AS dst, count(*) AS weight FROM refs a JOIN refs b ON a.ref = b.ref AND a.doc_id < b.doc_id GROUP BY 1, 2 HAVING count(*) >= 2)",
    "nodes": "nodes AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges)",
    "two": "two AS (SELECT src AS u, dst AS v, weight FROM edges UNION ALL SELECT dst, src, weight FROM edges)",
    "forms": """forms AS (SELECT DISTINCT l_orderkey AS doc_id, p_name AS item, CASE l_orderkey % 3 WHEN 1 THEN p_name || 's' ELSE p_name END AS plain,
        CASE l_orderkey % 3 WHEN 1 THEN p_name || 's' WHEN 2 THEN upper(p_name) ELSE p_name END AS raw FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey)""",
    "triples": """triples AS (SELECT DISTINCT l_orderkey AS doc_id, s_name || ', S.' AS author, 'Institute ' || s_suppkey % 20 AS institution, n_name AS country
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN orders ON l_orderkey = o_orderkey)""",
    "regions": "regions AS (SELECT n_name AS node, n_regionkey AS cluster FROM nation)",
}
GRAPH = ("countries", "edges", "nodes", "two", "regions")
COUPLED = ("refs", "coupled", "nodes", "two")


def with_(*names: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(CTE[n] for n in names)
