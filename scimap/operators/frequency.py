"""Counts, sums and top-k lists over documents and their items.

`items` are rows (doc_id, item), a row for each occurrence; where a document's repeated items count once, that is said.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def basic_stats(docs: DataFrame, authors: DataFrame, countries: DataFrame) -> DataFrame:
    """One row: documents, first and last year, sum and mean of citations, distinct authors, sources and countries.

    docs: doc_id, year, source, cited_by. An empty author name is an author. The distinct counts are aggregated in two
    steps, so that they are partial sums before they move.
    """
    d = docs.agg(
        F.count(F.lit(1)).alias("n_documents"),
        F.min("year").alias("first_year"),
        F.max("year").alias("last_year"),
        F.coalesce(F.sum("cited_by"), F.lit(0)).cast("long").alias("citations"),
        F.avg("cited_by").alias("mean_citations"),
    )
    for rows, col, name in ((authors, "item", "n_authors"), (docs, "source", "n_sources"), (countries, "item", "n_countries")):
        d = d.crossJoin(rows.select(F.col(col).alias("x")).where("x IS NOT NULL").distinct().agg(F.count(F.lit(1)).alias(name)))
    return d


def by_year(docs: DataFrame) -> DataFrame:
    """Documents in each year; those without a year don't count."""
    return docs.where(F.col("year").isNotNull()).groupBy("year").agg(F.count(F.lit(1)).alias("n"))


def author_totals(docs: DataFrame, authors: DataFrame) -> DataFrame:
    """(item, n, citations): full counting; empty names are left out."""
    a = authors.where("item <> ''").join(docs.select("doc_id", "cited_by"), "doc_id")
    return a.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("cited_by"), F.lit(0)).cast("long").alias("citations"))


def source_totals(docs: DataFrame) -> DataFrame:
    """(source, n, citations); n counts the documents that have a title."""
    d = docs.where(F.col("source").isNotNull())
    return d.groupBy("source").agg(F.count("title").alias("n"), F.coalesce(F.sum("cited_by"), F.lit(0)).cast("long").alias("citations"))


def frequency(items: DataFrame) -> DataFrame:
    """(item, n): occurrences; null and empty items are left out."""
    return items.where("item <> ''").groupBy("item").agg(F.count(F.lit(1)).alias("n"))


def document_frequency(items: DataFrame) -> DataFrame:
    """(item, n): documents that have the item."""
    return frequency(items.select("doc_id", "item").distinct())


def productivity(items: DataFrame) -> DataFrame:
    """(n_items, n): how many items occur n_items times."""
    return frequency(items).groupBy(F.col("n").alias("n_items")).agg(F.count(F.lit(1)).alias("n"))


def variant_merges(pairs: DataFrame, k: int = 15) -> DataFrame:
    """(canonical, n_variants, variants) of rows (raw, canonical): the k forms with the most raw variants, of those with several."""
    p = pairs.where("raw <> '' AND canonical <> ''").distinct()
    g = p.groupBy("canonical").agg(F.count(F.lit(1)).alias("n_variants"), F.array_join(F.sort_array(F.collect_set("raw")), "|").alias("variants"))
    return top(g.where("n_variants > 1"), k, F.col("n_variants").desc(), F.col("canonical"))


def top(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows by an order that should have no ties."""
    return rows.orderBy(*order).limit(k)


def top_first_seen(items: DataFrame, k: int) -> DataFrame:
    """(item, n): the k most frequent items; of equally frequent ones, those seen first. items: doc_id, pos, item."""
    g = items.where("item <> ''").groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "pos")).alias("first"))
    return top(g, k, F.col("n").desc(), F.col("first")).select("item", "n")


def top_per_group(rows: DataFrame, group: list[str], k: int, *order: Column) -> DataFrame:
    """The first k rows of each group with their rank; the ranks' limit is applied before rows move."""
    w = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def cumulative(counts: DataFrame, order: str = "year", value: str = "n") -> DataFrame:
    """counts with the running sum, for short series such as years."""
    w = Window.partitionBy(F.lit(1)).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumn("total", F.sum(value).over(w))


def item_stats(ratings: DataFrame) -> DataFrame:
    """(item, n, median, iqr, agreement): of rows (item, rating); agreement is the share of ratings of 4 or more."""
    return ratings.groupBy("item").agg(
        F.count(F.lit(1)).alias("n"),
        F.median("rating").alias("median"),
        (F.percentile("rating", F.lit(0.75)) - F.percentile("rating", F.lit(0.25))).alias("iqr"),
        F.avg((F.col("rating") >= 4).cast("int")).alias("agreement"),
    )


def cluster_summary(nodes: DataFrame, k: int = 5) -> DataFrame:
    """(cluster, n, occurrences, mean_year, top_labels) of rows (cluster, label, occurrences, year); years of 0 don't count."""
    g = nodes.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("occurrences").cast("long").alias("occurrences"),
        F.avg(F.when(F.col("year") != 0, F.col("year"))).alias("mean_year"),
    )
    best = top_per_group(nodes, ["cluster"], k, F.col("occurrences").desc(), F.col("label"))
    best = best.groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("rank", "label"))).alias("top"))
    return g.join(best, "cluster").withColumn("top_labels", F.array_join(F.col("top.label"), "|")).drop("top")
