"""Map and network files: tab-separated nodes and edges, any number of files in one scan.

A file is small (a map of some hundred nodes), and its header decides how its rows are read, so a file is one row until
its lines are numbered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A node's fields as (name, header, position where the header is missing, type, cells that a row must exceed).
FIELDS = [
    ("node", "id", 0, "int", 0),
    ("label", "label", 1, "string", 0),
    ("x", "x", 2, "double", 0),
    ("y", "y", 3, "double", 0),
    ("cluster", "cluster", 4, "int", 0),
    ("links", "weight<links>", 5, "int", 5),
    ("strength", "weight<total link strength>", 6, "int", 6),
    ("occurrences", "weight<occurrences>", 7, "int", 7),
    ("mean_year", "score<avg. pub. year>", 8, "double", 8),
    ("mean_citations", "score<avg. citations>", 9, "double", 9),
    ("mean_norm_citations", "score<avg. norm. citations>", 10, "double", 10),
]
OPTIONAL = {"mean_year", "mean_citations", "mean_norm_citations"}


def _lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(graph, line, cells): non-empty lines with their number; graph is the file's name without its ending."""
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1)
    t = spark.read.text(paths, wholetext=True).select(name.alias("graph"), F.regexp_replace("value", "^\ufeff", "").alias("value"))
    t = t.select("graph", F.posexplode(F.split("value", "\r?\n")).alias("line", "text"))
    cells = F.transform(F.split("text", "\t"), lambda c: F.regexp_replace(c, '^"(.*)"$', "$1"))
    return t.select("graph", "line", "text", cells.alias("cells"))


def read_maps(spark: SparkSession, paths: str | list[str], strict: bool = False) -> DataFrame:
    """(graph, node, label, x, y, cluster, links, strength, occurrences, mean_year, mean_citations, mean_norm_citations).

    A field is read by its header (case and blanks don't count). If the header lacks it, its usual position is read,
    whatever stands there; with strict it is null (0 for counts). Rows of fewer than 6 cells, and rows whose required
    cells aren't numbers, are skipped; of nodes with one id in a file the last counts.
    """
    t = _lines(spark, paths)
    heads = t.where("line = 0").select("graph", F.transform("cells", lambda c: F.lower(F.trim(c))).alias("head"))
    rows = t.where("line > 0").join(heads, "graph").where(F.size("cells") >= 6)

    def field(name: str, header: str, place: int, kind: str, least: int) -> Column:
        at = F.array_position("head", header)
        found = F.get("cells", F.when(at > 0, (at - 1).cast("int")).otherwise(F.lit(None if strict else place).cast("int")))
        value = found if kind == "string" else found.try_cast(kind)
        if name in OPTIONAL:
            # an empty cell at the usual position makes the field null
            return F.when((F.size("cells") > least) & (F.get("cells", F.lit(place)) != ""), value)
        if least:
            return F.when(F.size("cells") > least, F.coalesce(value, F.lit(0)) if strict else value).otherwise(F.lit(0))
        return value

    out = rows.select("graph", "line", *[field(*f).alias(f[0]) for f in FIELDS])
    required = [f[0] for f in FIELDS if f[0] not in OPTIONAL]
    out = out.dropna(subset=required)
    last = out.groupBy("graph", "node").agg(F.max("line").alias("line"))
    return out.join(last, ["graph", "node", "line"]).select("graph", *[f[0] for f in FIELDS])


def read_nets(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(graph, seq, src, dst, weight): lines of two or three integers; the weight is 1 where there is no third cell."""
    t = _lines(spark, paths).where(F.size("cells") >= 2)
    cell = lambda k: F.trim(F.get("cells", F.lit(k))).try_cast("int")
    weight = F.when(F.size("cells") > 2, cell(2)).otherwise(F.lit(1))
    return t.select("graph", F.col("line").alias("seq"), cell(0).alias("src"), cell(1).alias("dst"), weight.alias("weight")).dropna()


def assemble(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph, src, dst, weight): edges between nodes of their graph, each pair once, the last weight counting."""
    ends = nodes.select("graph", "node").distinct()
    e = edges.where("src <> dst")
    e = e.join(ends.withColumnRenamed("node", "src"), ["graph", "src"], "left_semi").join(ends.withColumnRenamed("node", "dst"), ["graph", "dst"], "left_semi")
    e = e.select("graph", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight", "seq")
    return e.groupBy("graph", "src", "dst").agg(F.max_by("weight", "seq").alias("weight"))
