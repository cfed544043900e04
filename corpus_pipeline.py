"""The corpus pipeline: quality filter, line dedup, near-dedup, source mix, byte-level BPE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scimap.llm import bpe, line_dedup, mixing, quality, simhash
from scimap.llm.common import right_sized, table, written

#: SQL for run()'s rows: fingerprints, scores and token ids can't be expressed.
ORACLE_SQL = None


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier (op 8) accepts, as learned from the labels of sf_dir."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that stand in at least 10 documents (op 5); n_chars follows, and no row goes."""
    d = line_dedup.dedup_lines(docs, min_docs=10)
    _, dropped, kept = (F.col(f"`{c}`") for c in d.columns[-3:])
    own = {"text": F.when(dropped > 0, kept).otherwise(F.col("text")), "n_chars": F.when(dropped > 0, F.length(kept).cast("long")).otherwise(F.col("n_chars"))}
    return right_sized(d.select(*[own.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns]))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component (op 6), that with the smallest id."""
    return right_sized(simhash.dedup(docs, words=3))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to source weights takes them (op 7)."""
    return right_sized(mixing.apply_mix(docs))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids (op 2), with digests of them and of the bytes that they decode to."""
    d = bpe.round_trip(docs.select("doc_id", "source", "text"))
    return d.select("doc_id", "source", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality_filter),
    ("line dedup", line_filter),
    ("simhash near-dedup", near_dedup),
    ("source mix", source_mix),
    ("byte-level bpe", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written as Parquet and read again. An empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
