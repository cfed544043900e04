"""Places for the nodes of a graph: a seeded spring layout as rounds of joins, and labels that don't cover each other.

Edges (src, dst, weight) pull their ends together; nodes near each other push each other apart. What is near is found by
a grid of cells: a node looks at its own cell and the eight about it. A cell of many nodes is one push from their centre,
so that no round forms all pairs of a cell. Forces are added up as whole numbers of billionths, and so don't hang on the
order in which rows meet: equal seeds give equal places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scimap.operators.graphs import both_ways
from scimap.sources.stores import checkpointed, released

#: The length at which pull and push of neighbours are equal; the side of a cell, beyond which nothing is pushed.
LENGTH, CELL = 1.0, 2.0
UNIT = 1e9


def _whole(force: Column) -> Column:
    return F.sum(F.round(force * UNIT).cast("long")) / UNIT


def _about(x: str, y: str, width: float, height: float) -> list[Column]:
    """The nine cells of a place's neighbourhood, as an array of (cx, cy), and its own cell."""
    cx, cy = F.floor(F.col(x) / width), F.floor(F.col(y) / height)
    near = F.array(*[F.struct((cx + i).alias("cx"), (cy + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    return [near, F.struct(cx.alias("cx"), cy.alias("cy"))]


def pushes(places: DataFrame, crowd: int) -> DataFrame:
    """(node, fx, fy): the pushes of all nodes nearer than CELL in the cells about a node; of the centre of all its nodes where
    a cell has more than `crowd`. Nodes at one place push each other along their order."""
    near, own = _about("x", "y", CELL, CELL)
    rows = places.select("node", "x", "y", own.alias("cell"))
    cells = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("mass"), _whole(F.col("x")).alias("x"), _whole(F.col("y")).alias("y"))
    cells = cells.select("cell", "mass", (F.col("x") / F.col("mass")).alias("x"), (F.col("y") / F.col("mass")).alias("y"))
    few = rows.join(cells.where(F.col("mass") <= crowd).select("cell"), "cell", "left_semi").select("cell", F.lit(1).cast("long").alias("mass"), F.col("x").alias("bx"), F.col("y").alias("by"), F.col("node").alias("other"))
    many = cells.where(F.col("mass") > crowd).select("cell", "mass", F.col("x").alias("bx"), F.col("y").alias("by"), F.lit(None).cast(rows.schema["node"].dataType).alias("other"))
    pairs = rows.select("node", "x", "y", F.explode(near).alias("cell")).join(few.unionByName(many), "cell").where("other IS NULL OR other <> node")
    dx, dy = F.col("x") - F.col("bx"), F.col("y") - F.col("by")
    same = (dx == 0) & (dy == 0)
    side = F.when(F.col("other").isNull(), 0.0).when(F.col("node") < F.col("other"), -1e-3).otherwise(1e-3)
    pairs = pairs.select("node", "mass", F.when(same, side).otherwise(dx).alias("dx"), dy.alias("dy"))
    square = F.greatest(F.lit(1e-6), F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    pairs = pairs.withColumn("push", F.when(square < CELL * CELL, LENGTH * LENGTH * F.col("mass") / square).otherwise(0.0))
    return pairs.groupBy("node").agg(_whole(F.col("push") * F.col("dx")).alias("fx"), _whole(F.col("push") * F.col("dy")).alias("fy"))


def spring(nodes: DataFrame, edges: DataFrame, rounds: int = 30, seed: int = 42, crowd: int = 32) -> DataFrame:
    """(node, x, y): places that edges pull together, the more the heavier, and nearness pushes apart.

    Nodes begin where the seed puts them, in a square with room for all. In each round they move along the sum of forces,
    less far from round to round. Nodes without edges are only pushed. An empty graph has no places.
    """
    n = nodes.select("node").distinct()
    size = max(1.0, n.count() ** 0.5) * LENGTH
    unit = lambda k: (F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "node"), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    places = checkpointed(n.select("node", (size * unit(1)).alias("x"), (size * unit(2)).alias("y")))
    top = edges.agg(F.max("weight").alias("_top"))
    e = checkpointed(both_ways(edges.where("src <> dst")).crossJoin(top).select("u", "v", (F.col("weight") / F.col("_top")).alias("w")))  # one row
    for i in range(rounds):
        apart = pushes(places, crowd)
        ends = e.join(places.select(F.col("node").alias("u"), F.col("x").alias("ux"), F.col("y").alias("uy")), "u").join(places.select(F.col("node").alias("v"), F.col("x").alias("vx"), F.col("y").alias("vy")), "v")
        dx, dy = F.col("vx") - F.col("ux"), F.col("vy") - F.col("uy")
        pull = (1 + F.col("w")) / 2 * F.sqrt(dx * dx + dy * dy) / LENGTH
        together = ends.groupBy(F.col("u").alias("node")).agg(_whole(pull * dx).alias("gx"), _whole(pull * dy).alias("gy"))
        d = places.join(apart, "node", "left").join(together, "node", "left").na.fill(0.0, ["fx", "fy", "gx", "gy"])
        fx, fy = F.col("fx") + F.col("gx"), F.col("fy") + F.col("gy")
        d = d.select("node", "x", "y", fx.alias("fx"), fy.alias("fy"), F.sqrt(fx * fx + fy * fy).alias("f"))
        far = size / 10 * (1 - i / rounds)
        step = F.when(F.col("f") > 0, F.least(F.col("f"), F.lit(far)) / F.col("f")).otherwise(0.0)
        now = checkpointed(d.select("node", F.round(F.col("x") + F.col("fx") * step, 9).alias("x"), F.round(F.col("y") + F.col("fy") * step, 9).alias("y")))
        released(places)
        places = now
    return places


def shown_labels(places: DataFrame, width: float = 1.5, height: float = 0.3) -> DataFrame:
    """places (node, x, y, n) with shown: labels of a width and height about their places that cover no other shown one.

    The label of largest n (of equal ones, of the smallest node) of each cell is shown if it comes before those of the
    cells about it that it would cover. Cells are as large as labels, so two labels of a cell always meet.
    """
    near, own = _about("x", "y", width, height)
    first = F.struct((-F.col("n")).alias("n"), "node", "x", "y")
    tops = checkpointed(places.select("*", own.alias("cell")).groupBy("cell").agg(F.min(first).alias("t")).select("cell", "t.*"))
    other = tops.select(F.col("cell"), *[F.col(c).alias(f"_{c}") for c in ("n", "node", "x", "y")])
    pairs = tops.select("n", "node", "x", "y", F.explode(near).alias("cell")).join(other, "cell").where("node <> _node")
    covers = (F.abs(F.col("x") - F.col("_x")) < width) & (F.abs(F.col("y") - F.col("_y")) < height)
    beaten = pairs.where(covers & (F.struct("_n", "_node") < F.struct("n", "node"))).select("node").distinct()
    free = tops.join(beaten, "node", "left_anti").select("node", F.lit(True).alias("shown"))
    return places.join(free, "node", "left").na.fill(False, ["shown"])
