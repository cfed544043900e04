"""Attribute scores of platforms and the rank correlations tested on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scimap.functions import lexicons as lex
from scimap.functions.text import joined_text, n_contained
from scimap.operators.agreement import spearman
from scimap.operators.screening import mentioned, with_hits
from scimap.sources.stores import checkpointed


def document_text(docs: DataFrame, columns: list[str]) -> DataFrame:
    """docs with text: the columns that exist and aren't null, joined, in lower case."""
    have = [F.col(c) for c in columns if c in docs.columns]
    return docs.withColumn("text", joined_text(*have) if have else F.lit(""))


def platform_scores(texts: DataFrame, platforms: list[str] = lex.PLATFORMS, attributes: dict | None = None, constructs: dict | None = None, patterns: dict | None = None) -> DataFrame:
    """A row for each mentioned platform: n_docs, the mean share of each attribute's terms, their total, those of the constructs, mean year and citations.

    texts: doc_id, text (lower case), year, cited_by. Platforms that no document mentions have no row.
    """
    attributes = lex.ADOPTION_ATTRIBUTES if attributes is None else attributes
    constructs = lex.ACCEPTANCE_CONSTRUCTS if constructs is None else constructs
    terms = attributes | constructs

    d, hits = with_hits(texts, platforms, patterns)

    def scored(text: Column) -> Column:
        """The platforms of a text, and only if there are any the numbers of terms: each is evaluated once."""
        found = F.struct(*[n_contained(text, t).alias(n) for n, t in terms.items()])
        return F.transform(F.array(mentioned(text, platforms, patterns, hits)), lambda p: F.struct(p.alias("platforms"), F.when(F.size(p) > 0, found).alias("found")))[0]

    rows = d.select("year", "cited_by", F.transform(F.array("text"), scored)[0].alias("_x"))
    rows = rows.select("year", "cited_by", "_x.found", F.explode_outer("_x.platforms").alias("platform")).where("platform IS NOT NULL")
    n_docs = F.count(F.lit(1))
    g = rows.groupBy("platform").agg(
        n_docs.alias("n_docs"),
        # whole numbers are summed, so that a mean doesn't depend on the order of rows
        *[(F.sum(F.col("found")[n]) / (n_docs * max(1, len(t)))).alias(n) for n, t in terms.items()],
        F.avg("year").alias("mean_year"),
        F.avg("cited_by").alias("mean_citations"),
    )
    total = sum((F.col(n) for n in attributes), F.lit(0.0))
    return g.withColumn("total", total)


def score_vs_centrality(scores: DataFrame, centrality: DataFrame) -> DataFrame:
    """(rho, n): total score against degree centrality of the node whose label is the platform; rho is null below 3 pairs.

    centrality: node, label, centrality; of nodes with one label (in lower case), that with the largest id counts.
    """
    last = centrality.groupBy(F.lower("label").alias("platform")).agg(F.max_by("centrality", "node").alias("y"))
    return _tested(scores.join(last, "platform").select(F.col("total").alias("x"), "y"))


def score_vs_year(scores: DataFrame) -> DataFrame:
    """(rho, n): total score against mean year."""
    return _tested(scores.select(F.col("total").alias("x"), F.col("mean_year").alias("y")))


def usefulness_vs_citations(scores: DataFrame) -> DataFrame:
    """(rho, n): perceived usefulness against mean citations."""
    return _tested(scores.select(F.col("perceived_usefulness").alias("x"), F.col("mean_citations").alias("y")))


def _tested(xy: DataFrame) -> DataFrame:
    """Ranks are joined to values by value: these are computed once, for sums of fractions computed again may differ."""
    return spearman(checkpointed(xy)).withColumn("rho", F.when(F.col("n") >= 3, F.col("rho")))
