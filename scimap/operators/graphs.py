"""Graph metrics as joins and aggregates. Edges are rows (src, dst, weight), src < dst, each pair once; nodes rows (node)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scimap.operators.ranks import keyed_join, running
from scimap.sources.stores import checkpointed, released


def build(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges between known nodes in one direction, without loops; of repeated ones the last by `seq` counts. edges: src, dst, weight, seq."""
    e = edges.where("src <> dst").join(nodes.select(F.col("node").alias("src")).distinct(), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")).distinct(), "dst", "left_semi")
    e = e.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight", "seq")
    return e.groupBy("src", "dst").agg(F.max_by("weight", "seq").alias("weight"))


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    """(u, v, weight): each edge in both directions, from one scan."""
    two = F.array(F.struct(F.col("src").alias("u"), F.col("dst").alias("v")), F.struct(F.col("dst").alias("u"), F.col("src").alias("v")))
    return edges.select("weight", F.inline(two))


def density(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row n, m, density, mean_degree; 0 where a denominator is."""
    g = nodes.agg(F.count(F.lit(1)).alias("n")).crossJoin(edges.agg(F.count(F.lit(1)).alias("m")))
    n, m = F.col("n"), F.col("m")
    return g.select("n", "m", F.coalesce(F.try_divide(2 * m, n * (n - 1)), F.lit(0.0)).alias("density"), F.coalesce(F.try_divide(2 * m, n), F.lit(0.0)).alias("mean_degree"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, degree, strength, centrality): neighbours, their weights' sum, and the share of all other nodes."""
    d = both_ways(edges).groupBy(F.col("u").alias("node")).agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("strength"))
    n = nodes.agg(F.count(F.lit(1)).alias("_n"))
    d = nodes.select("node").join(d, "node", "left").na.fill(0, ["degree", "strength"]).crossJoin(n)
    return d.select("node", "degree", "strength", F.coalesce(F.try_divide(F.col("degree"), F.col("_n") - 1), F.lit(0.0)).alias("centrality"))


def _triangles(edges: DataFrame) -> DataFrame:
    """(a, b, c, wab, wac, wbc): each triangle once. An edge points to its end of larger degree, so a hub starts few wedges."""
    d = both_ways(edges).groupBy("u").agg(F.count(F.lit(1)).alias("d"))
    e = edges.join(d.select(F.col("u").alias("src"), F.col("d").alias("ds")), "src").join(d.select(F.col("u").alias("dst"), F.col("d").alias("dd")), "dst")
    up = (F.col("ds") < F.col("dd")) | ((F.col("ds") == F.col("dd")) & (F.col("src") < F.col("dst")))
    e = e.select(F.when(up, F.col("src")).otherwise(F.col("dst")).alias("a"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("b"), "weight")
    x, y = e.select("a", "b", F.col("weight").alias("wab")), e.select("a", F.col("b").alias("c"), F.col("weight").alias("wac"))
    wedge = x.join(y, "a").where("b < c")
    close = edges.select(F.col("src").alias("b"), F.col("dst").alias("c"), F.col("weight").alias("wbc"))
    return wedge.join(close, ["b", "c"])


def clustering(nodes: DataFrame, edges: DataFrame, weighted: bool = False) -> DataFrame:
    """(node, clustering): triangles over pairs of neighbours, or their mean geometric weights relative to the largest; 0 below 2 neighbours."""
    value = F.lit(1.0)
    t = _triangles(edges)
    if weighted:
        t = t.crossJoin(edges.agg(F.max("weight").alias("_top")))
        value = F.cbrt((F.col("wab") / F.col("_top")) * (F.col("wac") / F.col("_top")) * (F.col("wbc") / F.col("_top")))
    per = t.select(F.explode(F.array("a", "b", "c")).alias("node"), value.alias("x")).groupBy("node").agg(F.sum("x").alias("t"))
    d = degrees(nodes, edges).join(per, "node", "left")
    return d.select("node", F.when(F.col("degree") >= 2, 2 * F.coalesce("t", F.lit(0.0)) / (F.col("degree") * (F.col("degree") - 1))).otherwise(0.0).alias("clustering"))


def mean_clustering(nodes: DataFrame, edges: DataFrame, weighted: bool = False) -> DataFrame:
    """One row clustering: the mean over all nodes; 0 for none."""
    return clustering(nodes, edges, weighted).agg(F.coalesce(F.avg("clustering"), F.lit(0.0)).alias("clustering"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable.

    Large and small stars in turn: each node links its larger neighbours, then itself and its smaller ones, to the
    smallest of all of them, until what is left are stars about components' smallest nodes. Rounds grow with the
    logarithm of the size, on long paths too. The neighbours of a hub are not brought together: see keyed_join().
    """
    two = [F.struct(F.col("src").alias("u"), F.col("dst").alias("v")), F.struct(F.col("dst").alias("u"), F.col("src").alias("v"))]
    e = checkpointed(edges.where("src <> dst").select("src", "dst").distinct())
    while True:
        b = e.select(F.inline(F.array(*two)))
        first = checkpointed(b.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n")))
        large = checkpointed(keyed_join(b.where("v > u"), first, "u", "n").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = checkpointed(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")))
        small = keyed_join(large, least, "u", "n").where("v <> m").select(F.col("v").alias("src"), F.col("m").alias("dst"))
        now = checkpointed(small.unionByName(least.select(F.col("u").alias("src"), F.col("m").alias("dst"))).distinct())
        done = least.where("n > 1").isEmpty() and now.join(now.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").isEmpty()
        released(e, first, large, least)
        e = now
        if done:
            own = e.select(F.col("src").alias("node"), F.col("dst").alias("component"))
            return nodes.select("node").distinct().join(own, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def modularity(edges: DataFrame, membership: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row modularity of a partition (node, cluster), weighted; 0 for one cluster and without edges."""
    a, b = membership.select(F.col("node").alias("src"), F.col("cluster").alias("ca")), membership.select(F.col("node").alias("dst"), F.col("cluster").alias("cb"))
    e = edges.join(a, "src").join(b, "dst")
    both = F.array(F.struct(F.col("ca").alias("cluster"), F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0).alias("inside")), F.struct(F.col("cb").alias("cluster"), F.lit(0).alias("inside")))
    c = e.select("weight", F.inline(both)).groupBy("cluster").agg(F.sum("inside").cast("double").alias("inside"), F.sum("weight").cast("double").alias("degree"))
    m = edges.agg(F.sum("weight").cast("double").alias("m"))
    k = membership.agg(F.countDistinct("cluster").alias("k"))
    q = c.crossJoin(m).agg(F.sum(F.try_divide("inside", "m") - resolution * F.pow(F.try_divide(F.col("degree"), 2 * F.col("m")), F.lit(2))).alias("q"))
    return q.crossJoin(k).select(F.when(F.col("k") > 1, F.coalesce("q", F.lit(0.0))).otherwise(0.0).alias("modularity"))


def numbered(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(node, i) with numbers from 0, (u, v, weight) in both directions by number, and how many nodes there are."""
    n = running(nodes.select("node").distinct().withColumn("_one", F.lit(1)), [F.col("node")], "_one")
    n = checkpointed(n.select("node", (F.col("i") - 1).cast("long").alias("i")))
    e = edges.where("src <> dst").join(n.select(F.col("node").alias("src"), F.col("i").alias("a")), "src").join(n.select(F.col("node").alias("dst"), F.col("i").alias("b")), "dst")
    two = F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))
    return n, checkpointed(e.select("weight", F.inline(two)).select("u", "v", "weight")), n.count()


def reach(nodes: DataFrame, edges: DataFrame, rows: int = 1 << 26) -> DataFrame:
    """(node, reached, total, farthest): of all nodes that a node is connected with, itself included, how many there are,
    the sum of the numbers of edges between them, and the largest of these.

    Breadth-first search from 64 sources in a machine word: a row (node, word) has a bit for each of the word's sources
    that has come to the node. In a round the bits that are new go along the edges, are joined by OR, and those not seen
    before are counted; sources and targets are the same nodes, so counts by target are counts by source. Distances of
    pairs are never rows. Words are searched so many at a time that there are `rows` rows at most.
    """
    n, e, count = numbered(nodes, edges)
    words = -(-count // 64)
    batch = max(1, rows // max(1, count))
    found = None
    for first in range(0, words, batch):
        some = n.where(F.col("i").between(64 * first, 64 * min(words, first + batch) - 1))
        bits = F.expr("shiftleft(1L, CAST(i % 64 AS INT))")
        state = some.select("i", F.expr("i div 64").alias("word"), bits.alias("seen"), bits.alias("new"), F.lit(1).alias("reached"), F.lit(0).cast("long").alias("total"), F.lit(0).alias("farthest"))
        d = 0
        while True:
            d += 1
            far = e.join(state.where("new <> 0").select(F.col("i").alias("u"), "word", "new"), "u")
            got = far.groupBy(F.col("v").alias("i"), "word").agg(F.bit_or("new").alias("got"))
            state = state.join(got, ["i", "word"], "full")
            fresh = F.coalesce(F.col("got").bitwiseAND(F.bitwise_not(F.coalesce("seen", F.lit(0)))), F.lit(0))
            state = state.select("i", "word", F.coalesce("seen", F.lit(0).cast("long")).alias("seen"), fresh.alias("new"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("reached", "total", "farthest")])
            k = F.bit_count("new")
            state = state.select("i", "word", F.col("seen").bitwiseOR(F.col("new")).alias("seen"), "new", (F.col("reached") + k).alias("reached"), (F.col("total") + d * k).alias("total"), F.when(k > 0, d).otherwise(F.col("farthest")).alias("farthest"))
            now = checkpointed(state)
            if d > 1:
                released(last)
            state = last = now
            if state.where("new <> 0").isEmpty():
                break
        own = state.groupBy("i").agg(F.sum("reached").alias("reached"), F.sum("total").alias("total"), F.max("farthest").alias("farthest"))
        found = own if found is None else found.unionByName(own)
    if found is None:
        return n.select("node", F.lit(0).cast("long").alias("reached"), F.lit(0).cast("long").alias("total"), F.lit(0).alias("farthest"))
    found = found.groupBy("i").agg(F.sum("reached").alias("reached"), F.sum("total").alias("total"), F.max("farthest").alias("farthest"))
    return n.join(found, "i").select("node", "reached", "total", "farthest")


def diameter(nodes: DataFrame, reached: DataFrame) -> DataFrame:
    """One row diameter: the largest distance of reach(); null if the graph isn't connected or has one node."""
    g = reached.agg(F.max("farthest").alias("d"), F.min("reached").alias("least")).crossJoin(nodes.agg(F.countDistinct("node").alias("n")))
    return g.select(F.when((F.col("n") > 1) & (F.col("least") == F.col("n")), F.col("d").cast("long")).alias("diameter"))


def closeness(nodes: DataFrame, reached: DataFrame) -> DataFrame:
    """(node, closeness) of reach(): reachable nodes over the sum of their distances, times their share of all others; 0 without any."""
    g = reached.crossJoin(nodes.agg(F.countDistinct("node").alias("n")))
    r = F.col("reached") - 1
    return g.select("node", F.coalesce(F.try_divide(r, F.col("total")) * F.try_divide(r, F.col("n") - 1), F.lit(0.0)).alias("closeness"))


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int | None = None, damping: float = 0.85, tolerance: float = 1e-6, most: int = 100) -> DataFrame:
    """(node, rank), weighted; nodes without edges give their rank to all. A fixed number of rounds, or until the change is below n * tolerance."""
    n = nodes.count()
    e = both_ways(edges)
    out = e.groupBy("u").agg(F.sum("weight").alias("w"))
    e = checkpointed(e.join(out, "u").select("u", "v", (F.col("weight") / F.col("w")).alias("share")))
    rank = checkpointed(nodes.select("node", F.lit(1.0 / max(n, 1)).alias("rank")).join(out.select(F.col("u").alias("node"), F.lit(True).alias("linked")), "node", "left"))
    alone = not rank.where("linked IS NULL").isEmpty()
    for i in range(rounds or most):
        got = e.join(rank.select(F.col("node").alias("u"), "rank"), "u").groupBy(F.col("v").alias("node")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        if alone:
            lost = rank.where("linked IS NULL").agg(F.sum("rank").alias("lost"))
            got = rank.select("node", F.col("rank").alias("old"), "linked").join(got, "node", "left").crossJoin(lost)
            value = damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / n) + (1 - damping) / n
            now = got.select("node", value.alias("rank"), "linked", "old")
        else:
            now = got.select("node", (damping * F.col("got") + (1 - damping) / n).alias("rank"), F.lit(True).alias("linked"))
        if rounds is None:
            if not alone:
                now = now.join(rank.select("node", F.col("rank").alias("old")), "node")
            now = checkpointed(now)
            if (now.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0] or 0.0) < n * tolerance:
                return now.select("node", "rank")
        elif i % 5 == 4:
            now = checkpointed(now)
        rank = now.select("node", "rank", "linked")
    return rank.select("node", "rank")


def eigenvector(nodes: DataFrame, edges: DataFrame, tolerance: float = 1e-6, most: int = 1000) -> DataFrame:
    """(node, centrality): power iteration on the weights plus the identity, from equal values; all 0 if it doesn't settle."""
    n = nodes.count()
    e = checkpointed(both_ways(edges))
    x = checkpointed(nodes.select("node", F.lit(1.0 / max(n, 1)).alias("x")))
    for _ in range(most):
        got = e.join(x.select(F.col("node").alias("u"), "x"), "u").groupBy(F.col("v").alias("node")).agg(F.sum(F.col("x") * F.col("weight")).alias("got"))
        y = x.join(got, "node", "left").select("node", F.col("x").alias("old"), (F.col("x") + F.coalesce("got", F.lit(0.0))).alias("y"))
        norm = y.agg(F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("norm"))
        y = checkpointed(y.crossJoin(norm).select("node", "old", (F.col("y") / F.col("norm")).alias("x")))
        change = y.agg(F.sum(F.abs(F.col("x") - F.col("old")))).first()[0] or 0.0
        x = y.select("node", "x")
        if change < n * tolerance:
            return x.withColumnRenamed("x", "centrality")
    return nodes.select("node", F.lit(0.0).alias("centrality"))


def callon(nodes: DataFrame, edges: DataFrame, membership: DataFrame) -> DataFrame:
    """(cluster, n, centrality, density): weights of a cluster's links to others, and of its own over its size."""
    a, b = membership.select(F.col("node").alias("src"), F.col("cluster").alias("ca")), membership.select(F.col("node").alias("dst"), F.col("cluster").alias("cb"))
    e = edges.join(a, "src").join(b, "dst")
    same = F.col("ca") == F.col("cb")
    rows = F.array(
        F.struct(F.col("ca").alias("cluster"), F.when(same, F.col("weight")).otherwise(0).alias("inside"), F.when(same, 0).otherwise(F.col("weight")).alias("outside")),
        F.struct(F.col("cb").alias("cluster"), F.lit(0).alias("inside"), F.when(same, 0).otherwise(F.col("weight")).alias("outside")),
    )
    g = e.select(F.inline(rows)).groupBy("cluster").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
    n = nodes.select("node").join(membership, "node").groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    zero = F.lit(0.0)
    return n.join(g, "cluster", "left").select("cluster", "n", F.coalesce(F.col("outside").cast("double"), zero).alias("centrality"), (F.coalesce(F.col("inside").cast("double"), zero) / F.col("n")).alias("density"))


def quadrants(metrics: DataFrame) -> DataFrame:
    """callon() with quadrant: above or at the medians of centrality and density, or below."""
    mid = metrics.agg(F.median("centrality").alias("_c"), F.median("density").alias("_d"))
    high_c, high_d = F.col("centrality") >= F.col("_c"), F.col("density") >= F.col("_d")
    q = F.when(high_c & high_d, "motor").when(high_c, "basic_transversal").when(high_d, "niche").otherwise("emerging_or_declining")
    return metrics.crossJoin(mid).withColumn("quadrant", q).drop("_c", "_d")


def network_metrics(nodes: DataFrame, edges: DataFrame, membership: DataFrame) -> DataFrame:
    """One row: n, m, density, mean_degree, clustering, components, modularity, diameter."""
    parts = components(nodes, edges).agg(F.countDistinct("component").alias("components"))
    row = density(nodes, edges).crossJoin(mean_clustering(nodes, edges)).crossJoin(parts).crossJoin(modularity(edges, membership))
    return row.crossJoin(diameter(nodes, reach(nodes, edges)))
