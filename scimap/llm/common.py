"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scimap.sources.stores import input_bytes, scratch

#: The white space that separates words: \x20 and \x09-\x0D.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(name: str) -> Column:
    """The column of that very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def in_files(df: DataFrame, a_core: int = 2, most: int = 64 << 20) -> DataFrame:
    """df in a_core partitions a core at most, so that it is not cut into very small files, but no fewer than one for
    each `most` bytes that it reads."""
    size = input_bytes(df)
    return df if size is None else df.coalesce(max(a_core * df.sparkSession.sparkContext.defaultParallelism, -(-size // most)))


def written(df: DataFrame, bucket_by: str | None = None, buckets: int = 0, small: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: later reads do not recompute it.

    small: a row has a few numbers; see in_files(). With bucket_by, the table is bucketed by that column, so that joins
    and groups on it move only the other side. A bucketed table is written by way of the catalog, which forgets its
    name at once; the files stay.
    """
    spark = df.sparkSession
    path = scratch(spark)
    out = (in_files(df) if small else df).write.option("compression", "zstd")
    if bucket_by is None:
        out.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    name = f"scimap_{uuid.uuid4().hex}"
    out.bucketBy(buckets, bucket_by).option("path", path).format("parquet").saveAsTable(name)
    table = spark.table(name)
    table.schema  # the plan holds files and buckets from here on
    spark.sql(f"DROP TABLE {name}")
    return table


def right_sized(df: DataFrame) -> DataFrame:
    """df in four partitions a core at most, or one for each 64 MB: a stage's result is not cut into very small files."""
    return in_files(df, 4)


def meet(texts: DataFrame, small: DataFrame, on: Column, how: str = "inner") -> DataFrame:
    """texts joined to a table of small rows, at every size alike: both sides are dealt by key, and the small one is
    hashed, so that texts are never sorted."""
    return texts.join(small.hint("shuffle_hash"), on, how)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores added until df has no such columns (in any case)."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def ascii_lower(c: Column) -> Column:
    """A-Z in lower case; other letters stay."""
    return F.translate(c, UPPER, LOWER)


def count_words(c: Column) -> Column:
    """The number of runs of other than white space; 0 for null."""
    return F.coalesce(F.regexp_count(c, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def fits(vector: Column) -> Column:
    """Whether a vector is there, without null or non-finite components."""
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def with_group_sum(df: DataFrame, key: str, value: str, out: str, share: int = 1024) -> DataFrame:
    """df, a written table, with out: the sum of the whole numbers `value` over the rows of equal key, nulls together.

    Keys that have more than 1 / share of all rows, fewer than `share` of them, are broadcast, so that their rows stay
    where they are; the rows of the others are dealt by key.
    """
    sums = df.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(value).cast("decimal(20,0)")).cast("long").alias(out))
    sums = written(sums, small=True)
    total = sums.agg(F.sum("_n")).first()[0] or 0
    hot, rest = sums.where(F.col("_n") * share > total), sums.where(F.col("_n") * share <= total)
    on = F.col(key).eqNullSafe(F.col("_key"))
    here = df.join(F.broadcast(hot), on)  # fewer than `share` rows
    there = df.join(F.broadcast(hot), on, "left_anti").join(rest.hint("shuffle_hash"), on)
    return here.unionByName(there).drop("_key", "_n")
