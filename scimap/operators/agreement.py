"""Agreement of partitions, ranks and raters, in closed forms over grouped counts."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scimap.operators.ranks import running
from scimap.sources.stores import checkpointed, spread


def _pairs(n: Column) -> Column:
    return n * (n - 1) / 2


def adjusted_rand(labels: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., n, ari) of rows (by..., a, b): the adjusted Rand index of two labellings of the same things.

    Fewer than two things, and labellings for which the index can't differ from its expectation, have 1.
    """
    by = by or []
    cells = labels.groupBy(*by, "a", "b").agg(F.count(F.lit(1)).alias("n"))
    sums = [cells.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(_pairs(F.col("n"))).alias("both"))]
    for side in ("a", "b"):
        g = cells.groupBy(*by, side).agg(F.sum("n").alias("n"))
        sums.append(g.groupBy(*by).agg(F.sum(_pairs(F.col("n"))).alias(f"in_{side}")))
    s = reduce(lambda x, y: x.join(y, by) if by else x.crossJoin(y), sums)
    expected = F.try_divide(F.col("in_a") * F.col("in_b"), _pairs(F.col("n")))
    most = (F.col("in_a") + F.col("in_b")) / 2
    ari = F.when((F.col("n") < 2) | (most == expected), F.lit(1.0)).otherwise(F.try_divide(F.col("both") - expected, most - expected))
    return s.select(*by, "n", ari.alias("ari"))


def against_baseline(membership: DataFrame, baseline: str) -> DataFrame:
    """(variant, n, ari): each variant's partition against the baseline's, on the union of all their nodes; missing is cluster -1.

    membership: variant, node, cluster.
    """
    # a row for each node, with its clusters by variant, is what both sides of a comparison are read from
    own = spread(membership, "node", a_task=1 << 20).groupBy("node").agg(F.collect_list(F.struct("variant", "cluster")).alias("_own"))
    grid = own.select("_own").crossJoin(F.broadcast(membership.select("variant").distinct()))  # broadcast: a row for each variant
    missing = F.array(F.lit(-1).cast(membership.schema["cluster"].dataType))

    def of(name: Column) -> Column:
        found = F.transform(F.filter("_own", lambda x: x["variant"] == name), lambda x: F.coalesce(x["cluster"], missing[0]))
        return F.when(F.size(found) > 0, found).otherwise(missing)

    rows = grid.select("variant", F.explode(of(F.lit(baseline))).alias("a"), of(F.col("variant")).alias("_b"))
    return adjusted_rand(rows.select("variant", "a", F.explode("_b").alias("b")), ["variant"])


def jaccard(sets: DataFrame) -> DataFrame:
    """(a, b, jaccard) of rows (side, key, member), side 'a' or 'b': all pairs of sets that share a member."""
    d = sets.distinct()
    size = d.groupBy("side", "key").agg(F.count(F.lit(1)).alias("size"))
    a = d.where("side = 'a'").select(F.col("key").alias("a"), "member")
    b = d.where("side = 'b'").select(F.col("key").alias("b"), "member")
    both = a.join(b, "member").groupBy("a", "b").agg(F.count(F.lit(1)).alias("both"))
    na = size.where("side = 'a'").select(F.col("key").alias("a"), F.col("size").alias("na"))
    nb = size.where("side = 'b'").select(F.col("key").alias("b"), F.col("size").alias("nb"))
    return both.join(na, "a").join(nb, "b").select("a", "b", (F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("jaccard"))


def stability(membership: DataFrame, baseline: str) -> DataFrame:
    """(variant, cluster, best): the best Jaccard match of each baseline cluster in each other variant; 0 without any."""
    base = membership.where(F.col("variant") == baseline).select(F.col("cluster").alias("a"), "node")
    other = membership.where(F.col("variant") != baseline).select("variant", F.col("cluster").alias("b"), "node")
    na = base.groupBy("a").agg(F.count(F.lit(1)).alias("na"))
    nb = other.groupBy("variant", "b").agg(F.count(F.lit(1)).alias("nb"))
    both = base.join(other, "node").groupBy("variant", "a", "b").agg(F.count(F.lit(1)).alias("both"))
    score = both.join(na, "a").join(nb, ["variant", "b"]).groupBy("variant", "a").agg(F.max(F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("best"))
    grid = other.select("variant").distinct().crossJoin(na.select("a"))
    return grid.join(score, ["variant", "a"], "left").select("variant", F.col("a").alias("cluster"), F.coalesce("best", F.lit(0.0)).alias("best"))


def kendall(xy: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., n, tau) of rows (by..., x, y): Kendall's tau-b; 0 for fewer than two rows or a constant side.

    Rows with equal (x, y) are one cell with a count. No pairs are formed: two x differ first at one binary digit of
    their ranks. For each digit, cells that agree before it are sorted by y, and a running count of those with 0 tells
    those with 1 how many are below and above them in y. Ranks and counts are by ranges: a group is in many tasks.
    """
    by = by or []
    cells = xy.groupBy(*by, "x", "y").agg(F.count(F.lit(1)).alias("n"))
    group = [*by, "_digit", "_before"]
    ranks = running(cells.select(*by, "x").distinct().withColumn("_one", F.lit(1)), [F.col("x")], "_one", by)
    ranks = checkpointed(ranks.select(*by, "x", (F.col("i") - 1).cast("long").alias("_rank")))
    digits = ranks.groupBy(*by).agg(F.length(F.bin(F.max("_rank"))).alias("_digits"))
    c = cells.join(ranks, [*by, "x"])
    c = c.join(digits, by) if by else c.crossJoin(digits)
    c = c.withColumn("_digit", F.explode(F.expr("sequence(0, _digits - 1)")))
    c = c.withColumn("_before", F.expr("shiftright(_rank, _digit + 1)")).withColumn("_one", F.expr("shiftright(_rank, _digit) & 1L") == 1)
    ys = c.groupBy(*group, "y").agg(*[F.sum(F.when(F.col("_one") == one, F.col("n")).otherwise(0)).alias(f"_n{int(one)}") for one in (False, True)])
    ys = running(ys, [F.col("y")], "_n0", group)
    diff = ys.groupBy(*by).agg(F.sum(F.col("_n1") * (2 * F.col("running") - F.col("_n0") - F.col("total"))).cast("double").alias("diff"))
    total = cells.groupBy(*by).agg(F.sum("n").alias("n"))
    ties = []
    for side in ("x", "y"):
        g = cells.groupBy(*by, side).agg(F.sum("n").alias("n"))
        ties.append(g.groupBy(*by).agg(F.sum(_pairs(F.col("n"))).alias(f"t{side}")))
    s = reduce(lambda u, v: u.join(v, by) if by else u.crossJoin(v), [total, *ties])
    s = s.join(diff, by, "left") if by else s.crossJoin(diff)
    root = F.sqrt((_pairs(F.col("n")) - F.col("tx")) * (_pairs(F.col("n")) - F.col("ty")))
    return s.select(*by, "n", F.coalesce(F.try_divide(F.col("diff"), root), F.lit(0.0)).alias("tau"))


def era_correlation(counts: DataFrame) -> DataFrame:
    """(era_a, era_b, n, tau) of reference counts (era, ref, n), for all pairs of eras, on the union of their references."""
    c = counts.select("era", "ref", "n")
    eras = c.select("era").distinct()
    two = eras.select(F.col("era").alias("era_a")).crossJoin(eras.select(F.col("era").alias("era_b"))).where("era_a < era_b")
    two = two.select("era_a", "era_b", F.explode(F.array("era_a", "era_b")).alias("era"))
    part = lambda side: F.sum(F.when(F.col("era") == F.col(side), F.col("n")).otherwise(0))
    xy = c.join(two, "era").groupBy("era_a", "era_b", "ref").agg(part("era_a").alias("x"), part("era_b").alias("y"))
    return kendall(xy.drop("ref"), ["era_a", "era_b"])


def mean_ranks(rows: DataFrame, value: str, out: str, by: list[str] | None = None) -> DataFrame:
    """rows with the rank of value, ties sharing their mean. Equal values are counted first, so a tie is one row in the sort."""
    by = by or []
    counts = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    counts = running(counts, [F.col(value)], "_n", by).withColumn("_before", F.col("running") - F.col("_n"))
    ranked = counts.select(*by, value, (F.col("_before") + (F.col("_n") + 1) / 2).alias(out))
    return rows.join(ranked, [*by, value])


def spearman(xy: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., n, rho) of rows (by..., x, y): Spearman's rank correlation; 0 below 3 rows or for a constant side."""
    by = by or []
    r = mean_ranks(mean_ranks(xy, "x", "rx", by), "y", "ry", by)
    g = r.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("rx").alias("sx"), F.stddev_pop("ry").alias("sy"), F.covar_pop("rx", "ry").alias("c"))
    good = (F.col("n") >= 3) & (F.col("sx") > 0) & (F.col("sy") > 0)
    return g.select(*by, "n", F.when(good, F.try_divide(F.col("c"), F.col("sx") * F.col("sy"))).otherwise(0.0).alias("rho"))


def cohen_kappa(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., n, kappa) of rows (by..., a, b), both boolean: two raters' agreement beyond chance; 1 where chance is sure."""
    by = by or []
    g = pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col("a") == F.col("b")).cast("int")).alias("po"),
        F.avg(F.col("a").cast("int")).alias("pa"),
        F.avg(F.col("b").cast("int")).alias("pb"),
    )
    pe = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    return g.select(*by, "n", F.when(pe >= 1, 1.0).otherwise(F.try_divide(F.col("po") - pe, 1 - pe)).alias("kappa"))


def rater_vectors(ratings: DataFrame, by: list[str], threshold: float) -> DataFrame:
    """(by..., rater, i, words): a row for each rater, numbered in its group from 0. words: (word, rated, high), bits of 64
    items each, in order: whether the rater has rated them, and at threshold or above. Of repeated ratings the highest counts."""
    one = F.lit(1).alias("_one")
    items = running(ratings.select(*by, "item").distinct().select("*", one), [F.col("item")], "_one", by).select(*by, "item", (F.col("i") - 1).alias("k"))
    bit = F.expr("shiftleft(1L, CAST(k % 64 AS INT))")
    r = ratings.join(items, [*by, "item"]).where("rating IS NOT NULL")
    w = r.groupBy(*by, "rater", F.expr("k div 64").alias("word")).agg(F.bit_or(bit).alias("rated"), F.bit_or(F.when(F.col("rating") >= threshold, bit).otherwise(0)).alias("high"))
    v = w.groupBy(*by, "rater").agg(F.sort_array(F.collect_list(F.struct("word", "rated", "high"))).alias("words"))
    n = running(v.select(*by, "rater", one), [F.col("rater")], "_one", by).select(*by, "rater", (F.col("i") - 1).alias("i"))
    return v.join(n, [*by, "rater"])


def _kappas(left: pd.DataFrame, right: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The kappa of each rater of left with each of right, and for how many items (nan where for none)."""
    at = {w: i for i, w in enumerate(sorted({x["word"] for side in (left, right) for ws in side["words"] for x in ws}))}

    def packed(side: pd.DataFrame) -> np.ndarray:
        out = np.zeros((2, len(at), len(side)), np.int64)
        for j, ws in enumerate(side["words"]):
            for x in ws:
                out[:, at[x["word"]], j] = x["rated"], x["high"]
        return out.view(np.uint64)  # of negative numbers bitwise_count() takes the absolute value

    (ra, ha), (rb, hb) = packed(left), packed(right)
    shape = (len(left), len(right))
    n, differ, a, b = (np.zeros(shape, np.int64) for _ in range(4))
    for w in range(len(at)):
        both = ra[w][:, None] & rb[w]
        n += np.bitwise_count(both)
        differ += np.bitwise_count((ha[w][:, None] ^ hb[w]) & both)
        a += np.bitwise_count(ha[w][:, None] & both)
        b += np.bitwise_count(hb[w] & both)
    with np.errstate(divide="ignore", invalid="ignore"):
        po, pa, pb = 1 - differ / n, a / n, b / n
        pe = pa * pb + (1 - pa) * (1 - pb)
        return np.where(pe >= 1, 1.0, (po - pe) / (1 - pe)), n


def _rater_blocks(ratings: DataFrame, by: list[str], threshold: float, block: int, make: Callable, fields: list[T.StructField]) -> DataFrame:
    """make(left, right, kappas, n) for each pair of blocks of raters, in a task each; n is 0 for pairs that are not due."""
    v = rater_vectors(ratings, by, threshold).withColumn("_block", F.expr(f"i div {block}"))
    blocks = v.groupBy(*by).agg((F.max("_block") + 1).alias("_blocks"))
    v = v.join(blocks, by) if by else v.crossJoin(blocks)  # one row
    pair = F.expr("transform(sequence(0L, _blocks - 1), x -> struct(least(x, _block) AS _a, greatest(x, _block) AS _b))")
    v = v.select(*by, "rater", "i", "words", "_block", F.inline(pair))
    out = T.StructType([v.schema[c] for c in by] + fields)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        left, right = (group[group["_block"] == group[side].iloc[0]].sort_values("i") for side in ("_a", "_b"))
        kappas, n = _kappas(left, right)
        n[left["i"].to_numpy()[:, None] >= right["i"].to_numpy()] = 0
        rows = make(left, right, kappas, n)
        for k, c in enumerate(by):
            rows.insert(k, c, group[c].iloc[0])
        return rows

    return v.groupBy(*by, "_a", "_b").applyInPandas(run, out)


def rater_pairs(ratings: DataFrame, by: list[str] | None = None, threshold: float = 4, block: int = 256) -> DataFrame:
    """cohen_kappa() of each pair of raters with common items, on rows (by..., rater, item, rating), ratings cut at threshold.

    Ratings become bits: a pair's agreement is counted 64 items at a time, in blocks of raters dealt to tasks. A task has
    two blocks' bits. Of repeated ratings of an item by a rater the highest counts.
    """
    rater = ratings.schema["rater"].dataType

    def rows(left: pd.DataFrame, right: pd.DataFrame, kappas: np.ndarray, n: np.ndarray) -> pd.DataFrame:
        i, j = np.nonzero(n)
        return pd.DataFrame({"rater_a": left["rater"].to_numpy()[i], "rater_b": right["rater"].to_numpy()[j], "n": n[i, j], "kappa": kappas[i, j]})

    fields = [T.StructField("rater_a", rater), T.StructField("rater_b", rater), T.StructField("n", T.LongType()), T.StructField("kappa", T.DoubleType())]
    return _rater_blocks(ratings, by or [], threshold, block, rows, fields)


def rater_pair_summary(ratings: DataFrame, by: list[str] | None = None, threshold: float = 4, block: int = 256) -> DataFrame:
    """(by..., n_pairs, mean, least, most) of rater_pairs()' kappas, of which a pair of blocks makes one row."""

    def rows(left: pd.DataFrame, right: pd.DataFrame, kappas: np.ndarray, n: np.ndarray) -> pd.DataFrame:
        k = kappas[n > 0]
        return pd.DataFrame({"n": [len(k)], "s": [k.sum()], "least": [k.min()], "most": [k.max()]} if len(k) else {"n": [], "s": [], "least": [], "most": []})

    fields = [T.StructField("n", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in ("s", "least", "most")]]
    g = _rater_blocks(ratings, by or [], threshold, block, rows, fields).groupBy(*(by or []))
    g = g.agg(F.sum("n").alias("n_pairs"), F.sum("s").alias("s"), F.min("least").alias("least"), F.max("most").alias("most"))
    return g.select(*(by or []), "n_pairs", (F.col("s") / F.col("n_pairs")).alias("mean"), "least", "most")


def item_sums(ratings: DataFrame, by: list[str]) -> DataFrame:
    """(by..., item, m, s, q): how many ratings an item has, their sum and that of their squares."""
    x = F.col("rating").cast("double")
    return ratings.groupBy(*by, "item").agg(F.count(F.lit(1)).alias("m"), F.sum(x).alias("s"), F.sum(x * x).alias("q"))


def krippendorff(ratings: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., n, alpha) of rows (by..., item, rating): 1 - observed / expected squared differences; 1 where none is
    expected, and where no item has two ratings.

    The sum of squared differences of n values over all pairs is n * sum(x^2) - sum(x)^2: no pair is formed.
    """
    by = by or []
    return alpha_of_items(item_sums(ratings, by), by)


def alpha_of_items(items: DataFrame, by: list[str]) -> DataFrame:
    """krippendorff() of item_sums()."""
    g = items.groupBy(*by).agg(
        F.sum(F.col("m") * F.col("q") - F.col("s") * F.col("s")).alias("inside"),
        F.sum(_pairs(F.col("m"))).alias("inside_pairs"),
        F.sum("m").alias("n"),
        F.sum("s").alias("s"),
        F.sum("q").alias("q"),
    )
    do = F.try_divide(F.col("inside"), F.col("inside_pairs"))
    de = F.try_divide(F.col("n") * F.col("q") - F.col("s") * F.col("s"), _pairs(F.col("n")))
    return g.select(*by, "n", F.when(F.coalesce(de, F.lit(0.0)) == 0, 1.0).otherwise(1 - F.try_divide(F.coalesce(do, F.lit(0.0)), de)).alias("alpha"))
