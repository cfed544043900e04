"""Ranks and running sums over whole tables or large groups, and joins on keys of any share, without bringing a table or a
group to one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scimap.sources.stores import shared_dir


def running(df: DataFrame, order: list[Column], value: str, by: Sequence[str] = ()) -> DataFrame:
    """df with i (rank by order, from 1), running (sum of value up to the row) and total (sum of all), in each group of by.

    Rows are dealt to partitions by ranges of groups and order, so that a large group is in many partitions and a
    partition may hold many groups. A partition's rows of a group are ranked by themselves, and what stands before them is
    added: counts and sums of the group's other partitions, of which there are as many as shuffle partitions at most.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shared_dir(df.sparkSession)
    # a checkpoint, not a file read again: order may have columns of df itself
    d = df.repartitionByRange(n, *[F.col(c) for c in by], *order).withColumn("_part", F.spark_partition_id()).checkpoint()
    keys = [F.col(c).alias(f"_by{k}") for k, c in enumerate(by)]
    parts = d.groupBy(F.col("_part").alias("_p"), *keys).agg(F.count(F.lit(1)).alias("_rows_before"), F.sum(value).alias("_sum_before"))
    group = [f"_by{k}" for k in range(len(by))]
    all_ = Window.partitionBy(*(group or [F.lit(1)]))
    before = all_.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        "_p",
        *group,
        F.coalesce(F.sum("_rows_before").over(before), F.lit(0)).alias("_rows_before"),
        F.coalesce(F.sum("_sum_before").over(before), F.lit(0)).alias("_sum_before"),
        F.sum("_sum_before").over(all_).alias("total"),
    )
    own = Window.partitionBy("_part", *by).orderBy(*order)
    d = d.withColumn("i", F.row_number().over(own)).withColumn("running", F.sum(value).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    on = F.col("_part") == F.col("_p")
    for c, k in zip(by, group, strict=True):
        on = on & F.col(c).eqNullSafe(F.col(k))
    d = d.join(parts if by else F.broadcast(parts), on)  # broadcast: a row for each shuffle partition
    return d.select(*df.columns, (F.col("i") + F.col("_rows_before")).alias("i"), (F.col("running") + F.col("_sum_before")).alias("running"), "total")


def keyed_join(rows: DataFrame, per_key: DataFrame, key: str, count: str, share: int = 1024) -> DataFrame:
    """rows joined to per_key (one row a key, computed already) by key. count: a column of per_key, the key's rows.

    Keys with more than 1 / share of all rows, fewer than `share` of them, are broadcast, so that their rows stay where
    they are; the rows of the others are dealt by key.
    """
    total = per_key.agg(F.sum(count)).first()[0] or 0
    hot, rest = per_key.where(F.col(count) * share > total), per_key.where(F.col(count) * share <= total)
    there = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key)
    return rows.join(F.broadcast(hot), key).unionByName(there)
