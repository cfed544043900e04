"""The data of figures, and TikZ fragments made of it."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scimap.functions.text import latex_escape
from scimap.operators.frequency import cumulative, top, top_per_group
from scimap.operators.laws import concentration_curve
from scimap.operators.trends import item_years
from scimap.sources.sinks import rows_of


def network_plot(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with size and label (of 3 occurrences or more), edges with width relative to the heaviest. nodes: node, label, occurrences."""
    n = nodes.withColumn("size", F.col("occurrences") * 50 + 100).withColumn("text", F.when(F.col("occurrences") >= 3, F.col("label")))
    e = edges.crossJoin(edges.agg(F.max("weight").alias("_top"))).withColumn("width", F.col("weight") / F.col("_top") * 3 + 0.5).drop("_top")
    return n, e


def induced(nodes: DataFrame, edges: DataFrame, k: int = 40) -> tuple[DataFrame, DataFrame]:
    """The k most frequent nodes (node, n) and the edges between them."""
    best = top(nodes, k, F.col("n").desc(), F.col("node"))
    e = edges.join(best.select(F.col("node").alias("src")), "src", "left_semi").join(best.select(F.col("node").alias("dst")), "dst", "left_semi")
    return best, e.select("src", "dst", "weight")


def cluster_heatmap(clusters: DataFrame) -> DataFrame:
    """A row for each graph with the sizes of its clusters as columns. clusters: graph, cluster, n.

    More clusters than a figure can show (200) are an error: clusters itself is the long form.
    """
    ids = [r["cluster"] for r in rows_of(clusters.select("cluster").distinct().orderBy("cluster"), 200)]
    return clusters.groupBy("graph").pivot("cluster", ids).agg(F.sum("n")).na.fill(0)


def completeness(counts: DataFrame) -> DataFrame:
    """(year, n, total, share): documents of each year, so far, and the latter's share of all."""
    c = cumulative(counts)
    return c.crossJoin(c.agg(F.max("total").alias("_all"))).select("year", "n", "total", (F.col("total") / F.col("_all")).alias("share"))


def thematic_scatter(quadrants: DataFrame) -> DataFrame:
    """(cluster, n, x, y, quadrant): centrality and density, as shares of the largest of each (0 if that is 0)."""
    share = lambda c: F.coalesce(F.try_divide(F.col(c), F.col(f"_{c}")), F.lit(0.0))
    most = quadrants.agg(*[F.max(c).alias(f"_{c}") for c in ("centrality", "density")])
    return quadrants.crossJoin(most).select("cluster", "n", share("centrality").alias("x"), share("density").alias("y"), "quadrant")


def era_panels(eras: DataFrame, measures: tuple[str, ...] = ("n", "m", "density")) -> DataFrame:
    """(era, measure, value): a row for each bar of each measure's panel."""
    return eras.select("era", *[F.col(c).cast("double").alias(c) for c in measures]).unpivot("era", list(measures), "measure", "value")


def timeline(series: DataFrame, fits: list[dict], points: int = 80, ahead: int = 5) -> list[dict]:
    """The curves (model, x, y) of fitted growth models over the series' years and `ahead` more, as rows on the driver."""
    years = [r["year"] for r in series.select("year").orderBy("year").collect()]
    if not years:
        return []
    span = years[-1] - years[0] + ahead
    return [{"model": f["model"], "x": years[0] + span * i / (points - 1), "y": f["curve"](span * i / (points - 1))} for f in fits for i in range(points)]


def lotka_curve(alpha: float, c: float, most: int, points: int = 60) -> list[tuple[float, float]]:
    """The fitted law at evenly spaced logarithms from 1 to `most`."""
    xs = [math.exp(math.log(most) * i / (points - 1)) for i in range(points)]
    return [(x, c * x**-alpha) for x in xs]


def trend_heatmap(items: DataFrame, first_year: int = 2008, k: int = 15) -> DataFrame:
    return item_years(items, k).where(F.col("year") >= first_year)


def zone_sources(zones: DataFrame, k: int = 12, per_zone: int = 25) -> DataFrame:
    """The k largest sources of the per_zone largest of each zone."""
    return top(top_per_group(zones, ["zone"], per_zone, F.col("i")), k, F.col("i")).select("item", "n", "zone")


def scattering_curve(zones: DataFrame, per_zone: int = 25) -> DataFrame:
    """The concentration curve over the per_zone largest sources of each zone."""
    return concentration_curve(top_per_group(zones, ["zone"], per_zone, F.col("i")).select("item", "n"))


def circular_layout(names: list[str], radius: float = 4.0) -> dict[str, tuple[float, float]]:
    """Places on a circle, the first at the right, counter-clockwise."""
    return {n: (radius * math.cos(2 * math.pi * i / len(names)), radius * math.sin(2 * math.pi * i / len(names))) for i, n in enumerate(names)}


def tikz(body: str) -> str:
    return f"% Generated; changes are lost.\n{body}\n"


def tikz_bars(rows: DataFrame, label: str, value: str, title: str) -> str:
    """Horizontal bars, the largest on top."""
    data = rows_of(rows.select(label, value))[::-1]
    names = ",".join("{" + latex_escape(str(r[label])) + "}" for r in data)
    points = " ".join(f"({r[value]},{i})" for i, r in enumerate(data))
    ticks = ",".join(map(str, range(len(data))))
    return tikz(
        "\\begin{tikzpicture}\n\\begin{axis}[xbar, xmin=0, title={" + latex_escape(title) + "}, ytick={" + ticks + "}, yticklabels={" + names + "}]\n"
        "\\addplot coordinates {" + points + "};\n\\end{axis}\n\\end{tikzpicture}"
    )


def tikz_lines(series: dict[str, list[tuple[float, float]]], title: str, log: bool = False) -> str:
    """Lines by name."""
    plots = "\n".join("\\addplot coordinates {" + " ".join(f"({x:g},{y:g})" for x, y in pts) + "};\n\\addlegendentry{" + latex_escape(name) + "}" for name, pts in series.items())
    kind = "loglogaxis" if log else "axis"
    return tikz(f"\\begin{{tikzpicture}}\n\\begin{{{kind}}}[title={{{latex_escape(title)}}}]\n{plots}\n\\end{{{kind}}}\n\\end{{tikzpicture}}")


def tikz_graph(nodes: DataFrame, edges: DataFrame) -> str:
    """Nodes (node, n) on a circle, edges (src, dst, weight) as chords of a width by weight."""
    ns, es = rows_of(nodes), rows_of(edges)
    place = circular_layout([str(r["node"]) for r in ns])
    number = {name: i for i, name in enumerate(place)}
    heaviest = max((r["weight"] for r in es), default=1)
    lines = [f"\\node (n{number[n]}) at ({x:.3f},{y:.3f}) {{{latex_escape(n)}}};" for n, (x, y) in place.items()]
    lines += [f"\\draw[line width={0.3 + 2 * r['weight'] / heaviest:.2f}pt] (n{number[str(r['src'])]}) -- (n{number[str(r['dst'])]});" for r in es]
    return tikz("\\begin{tikzpicture}\n" + "\n".join(lines) + "\n\\end{tikzpicture}")
