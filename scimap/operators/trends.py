"""Items over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scimap.operators.frequency import top


def item_years(items: DataFrame, k: int = 25) -> DataFrame:
    """(item, year, n) for the k most frequent items (ties by name) in each year that any item has; 0 where there is none.

    items: item, year; rows without a year don't count.
    """
    d = items.where("item <> '' AND year IS NOT NULL").select("item", "year")
    c = d.groupBy("item", "year").agg(F.count(F.lit(1)).alias("n"))
    best = top(c.groupBy("item").agg(F.sum("n").alias("total")), k, F.col("total").desc(), F.col("item")).select("item")
    grid = best.crossJoin(c.select("year").distinct())
    return grid.join(c, ["item", "year"], "left").select("item", "year", F.coalesce("n", F.lit(0)).alias("n"))


def emergence(matrix: DataFrame, window: int = 3) -> DataFrame:
    """(item, recent, prior, emergence_index) of item_years(): the last `window` observed years against those before.

    Without 2 * window observed years the prior is 0; the index is (recent - prior) / max(prior, 1).
    """
    years = matrix.select("year").distinct()
    w = Window.partitionBy(F.lit(1)).orderBy(F.col("year").desc())
    years = years.withColumn("back", F.row_number().over(w)).withColumn("n_years", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))))
    m = matrix.join(years, "year")
    prior = (F.col("back") > window) & (F.col("back") <= 2 * window) & (F.col("n_years") >= 2 * window)
    g = m.groupBy("item").agg(
        F.coalesce(F.sum(F.when(F.col("back") <= window, F.col("n"))), F.lit(0)).alias("recent"),
        F.coalesce(F.sum(F.when(prior, F.col("n"))), F.lit(0)).alias("prior"),
    )
    return g.withColumn("emergence_index", (F.col("recent") - F.col("prior")) / F.greatest(F.col("prior"), F.lit(1)))


def year_pivot(matrix: DataFrame, years: list[int]) -> DataFrame:
    """A row for each item with a column for each of the given years."""
    return matrix.groupBy("item").pivot("year", years).agg(F.sum("n")).na.fill(0)


def linear_trend(series: DataFrame) -> DataFrame:
    """One row slope, intercept of n against year."""
    return series.agg(F.regr_slope("n", "year").alias("slope"), F.regr_intercept("n", "year").alias("intercept"))


