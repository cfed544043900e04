"""A two-round expert panel: simulated ratings, revision towards the median, and reliability. ratings: cluster, round, rater, item, rating."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scimap.operators.agreement import alpha_of_items, krippendorff, rater_pair_summary
from scimap.operators.frequency import item_stats
from scimap.operators.ranks import running
from scimap.sources.stores import checkpointed


def _noise(seed: int, *cols: str):
    """A standard normal value that the seed and the columns fix: it doesn't depend on how rows are dealt."""
    unit = lambda k: (F.pmod(F.xxhash64(F.lit(seed), F.lit(k), *cols), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    return F.sqrt(-2 * F.ln(unit(1))) * F.cos(2 * F.pi() * unit(2))


def draws(seed: int, *cols: str):
    """A uniform value in (0, 1) that the seed and the columns fix."""
    return (F.pmod(F.xxhash64(F.lit(seed), F.lit(3), *cols), F.lit(1 << 40)) + 0.5) / float(1 << 40)


def round_one(panel: DataFrame, clusters: DataFrame, items: int = 10, reverse: tuple[int, ...] = (5, 6), spread: float = 0.6, seed: int = 42) -> DataFrame:
    """Ratings 1 to 5 about each cluster's consensus. panel: rater, experience; clusters: cluster, consensus.

    More than 15 years of experience shade a rating by 0.15 up, fewer than 8 down. Reverse items are rated about
    6 - consensus, shaded the other way.
    """
    bias = F.when(F.col("experience") > 15, 0.15).when(F.col("experience") < 8, -0.15).otherwise(0.0)
    grid = clusters.crossJoin(panel).withColumn("item", F.explode(F.sequence(F.lit(1), F.lit(items))))
    centre = F.when(F.col("item").isin(*reverse), 6 - F.col("consensus") - bias).otherwise(F.col("consensus") + bias)
    rating = F.greatest(F.lit(1), F.least(F.lit(5), F.bround(centre + spread * _noise(seed, "cluster", "rater", "item")).cast("int")))
    return grid.select("cluster", F.lit(1).alias("round"), "rater", "item", rating.alias("rating"))


def round_two(first: DataFrame, draw=None, seed: int = 42, share: float = 0.3) -> DataFrame:
    """Ratings 2 or more from their item's median move half way to it, half to even, where the draw is below share."""
    draw = draws(seed, "cluster", "rater", "item") if draw is None else draw
    m = F.median("rating").over(Window.partitionBy("cluster", "item"))
    f = first.withColumn("_m", m)
    far = (F.abs(F.col("rating") - F.col("_m")) >= 2) & (draw < share)
    return f.withColumn("rating", F.when(far, F.bround((F.col("rating") + F.col("_m")) / 2).cast("int")).otherwise(F.col("rating"))).withColumn("round", F.lit(2)).drop("_m")


def item_aggregates(ratings: DataFrame) -> DataFrame:
    """item_stats() of each cluster, round and item."""
    key = F.struct("cluster", "round", "item")
    return item_stats(ratings.select(key.alias("item"), "rating")).select("item.*", "n", "median", "iqr", "agreement")


def kappa_summary(ratings: DataFrame) -> DataFrame:
    """(cluster, n_pairs, mean, least, most) of the kappas of all pairs of raters over all items, cut at 4."""
    return rater_pair_summary(ratings, ["cluster"])


def seats(raters: DataFrame, replicates: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(cluster, rater, seat, n), and (cluster, replicate, seat) for each draw.

    A replicate draws as many seats as its cluster has raters, with replacement; the rater on a seat is fixed by the
    first eight hexadecimal digits of the MD5 of `seed:cluster:replicate:seat`.
    """
    r = running(raters.select("cluster", "rater", F.lit(1).alias("_one")), [F.col("rater")], "_one", ["cluster"])
    r = checkpointed(r.select("cluster", "rater", (F.col("i") - 1).cast("long").alias("seat"), F.col("total").alias("n")))
    text = F.concat_ws(":", F.lit(str(seed)), F.col("cluster").cast("string"), F.col("replicate").cast("string"), F.col("seat").cast("string"))
    drawn = r.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    return r, drawn.select("cluster", "replicate", (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % F.col("n")).alias("seat"))


def multiplicities(raters: DataFrame, replicates: int, seed: int) -> DataFrame:
    """(cluster, rater, times): how often each replicate's panel has the rater, an array with a number for each replicate."""
    r, drawn = seats(raters, replicates, seed)
    counts = drawn.groupBy("cluster", "seat", "replicate").agg(F.count(F.lit(1)).alias("k"))
    known = counts.groupBy("cluster", "seat").agg(F.map_from_entries(F.collect_list(F.struct("replicate", "k"))).alias("of"))
    times = F.transform(F.sequence(F.lit(1), F.lit(replicates)), lambda i: F.coalesce(F.col("of")[i], F.lit(0)))
    return r.join(known, ["cluster", "seat"]).select("cluster", "rater", times.alias("times"))


def bootstrap_alpha(ratings: DataFrame, replicates: int = 300, seed: int = 42) -> DataFrame:
    """(cluster, alpha, low, high): alpha with the 2.5 and 97.5 percentiles over resampled panels.

    A rater stands in a replicate as often as seats() draws its seat. Alpha wants counts, sums and sums of squares by
    item, so each draw meets its rater's ratings, which are hashed, and is summed by replicate and item where it is: draws
    are never sorted or kept. Replicates in which a panel has no rating of two raters count as krippendorff() says.
    """
    r, drawn = seats(ratings.select("cluster", "rater").distinct(), replicates, seed)
    own = ratings.groupBy("cluster", "rater").agg(F.collect_list(F.struct("item", F.col("rating").cast("double").alias("x"))).alias("_own"))
    own = r.select("cluster", "rater", "seat").join(own, ["cluster", "rater"]).select("cluster", "seat", "_own")
    rows = drawn.join(own.hint("shuffle_hash"), ["cluster", "seat"]).select("cluster", "replicate", F.inline("_own"))
    # of a null rating there is a row, as in item_sums()
    items = rows.groupBy("cluster", "replicate", "item").agg(F.count(F.lit(1)).alias("m"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    alphas = alpha_of_items(items, ["cluster", "replicate"])
    g = alphas.groupBy("cluster").agg(F.count(F.lit(1)).alias("replicates"), F.percentile("alpha", F.lit(0.025)).alias("low"), F.percentile("alpha", F.lit(0.975)).alias("high"))
    return krippendorff(ratings, ["cluster"]).select("cluster", "alpha").join(g, "cluster")


def decisions(aggregates: DataFrame, item: int = 10) -> DataFrame:
    """(cluster, decision): RETAIN where the item's second-round median is 4 or more, else REVISE."""
    a = aggregates.where((F.col("round") == 2) & (F.col("item") == item))
    return a.select("cluster", F.when(F.col("median") >= 4, "RETAIN").otherwise("REVISE").alias("decision"))


def simulate(panel: DataFrame, clusters: DataFrame, replicates: int = 300, seed: int = 42) -> dict[str, DataFrame]:
    """Both rounds with their aggregates, kappas, alphas and decisions."""
    one = round_one(panel, clusters, seed=seed)
    two = round_two(one, seed=seed)
    both = one.unionByName(two)
    a = item_aggregates(both)
    return {"ratings": both, "aggregates": a, "kappa": kappa_summary(two), "alpha": bootstrap_alpha(two, replicates, seed), "decisions": decisions(a)}
