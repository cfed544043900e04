"""Bibliographic exports (CSV) as the corpus tables that operators take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scimap.functions.text import affiliations, reference_key, simple_countries, split_field

# Cells that are missing values.
NULL_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

#: Export column -> corpus column.
COLUMNS = {
    "Authors": "authors_raw",
    "Title": "title",
    "Year": "year",
    "Source title": "source",
    "Cited by": "cited_by",
    "Author Keywords": "keywords_raw",
    "Index Keywords": "index_keywords_raw",
    "Abstract": "abstract",
    "Affiliations": "affiliations_raw",
    "Authors with affiliations": "authors_affiliations_raw",
    "References": "references_raw",
}


def read_corpus(spark: SparkSession, path: str, year_max: int | None = None) -> DataFrame:
    """The export's rows: doc_id, then the corpus's columns; those that the file lacks are null.

    Quoted cells may hold line breaks and doubled quotes. Header names are stripped. Years that aren't numbers are
    null and citations 0; other columns keep their text. Ids are given before the year cap, which drops null years.
    """
    raw = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    names = {c.strip().lstrip("\ufeff"): c for c in raw.columns}

    def cell(name: str) -> Column:
        if name not in names:
            return F.lit(None).cast("string")
        c = F.col(f"`{names[name]}`")
        return F.when(~F.coalesce(c, F.lit("")).isin(NULL_TOKENS), c)

    def number(name: str) -> Column:
        return cell(name).try_cast("double")

    rows = []
    for name, out in COLUMNS.items():
        if out == "year":
            c = number(name).cast("int")
        elif out == "cited_by":
            c = F.coalesce(number(name), F.lit(0.0)).cast("long")
        else:
            c = cell(name)
        rows.append(c.alias(out))
    docs = raw.select(F.monotonically_increasing_id().alias("doc_id"), *rows)
    return docs if year_max is None else docs.where(F.col("year") <= year_max)


def exploded(docs: DataFrame, column: str) -> DataFrame:
    """(doc_id, pos, item) of a delimited column."""
    return docs.select("doc_id", F.posexplode(split_field(F.col(column))).alias("pos", "item"))


def authors(docs: DataFrame) -> DataFrame:
    return exploded(docs, "authors_raw")


def keywords(docs: DataFrame, column: str = "keywords_raw") -> DataFrame:
    return exploded(docs, column)


def references(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, ref) of the references that have a key."""
    r = docs.select("doc_id", F.posexplode(split_field(F.col("references_raw"))).alias("pos", "x"))
    return r.select("doc_id", "pos", reference_key(F.col("x")).alias("ref")).where("ref IS NOT NULL")


def affiliation_triples(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, author, institution, country)."""
    a = docs.select("doc_id", F.posexplode(affiliations(F.col("authors_affiliations_raw"))).alias("pos", "x"))
    return a.select("doc_id", "pos", "x.author", "x.institution", "x.country")


def countries(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, item) of the plain affiliation column."""
    return docs.select("doc_id", F.posexplode(simple_countries(F.col("affiliations_raw"))).alias("pos", "item"))
