"""Report files. Tables that are written as one file or one string are results of a bounded size; others use df.write."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scimap.functions.text import latex_escape

#: Reports are of at most so many rows; larger results are tables, not reports.
MOST = 100_000


def rows_of(df: DataFrame, most: int = MOST) -> list[dict]:
    """The rows as dictionaries, refused if there are more than `most`."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: write the DataFrame as a table")
    return [r.asDict(recursive=True) for r in rows]


def write_report(path: str, parts: dict[str, DataFrame | dict | list | str]) -> str:
    """A JSON object with the rows of each DataFrame; a DataFrame of one row without a key stays a list of one."""
    data = {k: rows_of(v) if isinstance(v, DataFrame) else v for k, v in parts.items()}
    Path(path).write_text(json.dumps(data, indent=2, ensure_ascii=False, default=str), encoding="utf-8")
    return path


def write_reports(path: str, reports: dict[str, dict[str, DataFrame]], most: int = MOST) -> str:
    """A folder with a JSON file for each report: an object with the rows of each DataFrame, as a list in their order.

    Written by Spark, in any store; a part's rows are gathered in one task, and refused if there are more than `most`.
    """
    for name, parts in reports.items():
        row = None
        for key, df in parts.items():
            some = df.limit(most + 1).agg(F.collect_list(F.struct(*df.columns)).alias("rows"))
            some = some.select(F.when(F.size("rows") <= most, F.col("rows")).otherwise(F.raise_error(F.lit(f"more than {most} rows: write the DataFrame as a table"))).alias(key))
            row = some if row is None else row.crossJoin(some)  # one row each
        row.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/_{name}")
        _one_file(row.sparkSession, f"{path}/_{name}", f"{path}/{name}.json")
    return path


def _one_file(spark, folder: str, path: str) -> None:
    """Moves the one part file of a folder that Spark has written to path, and deletes the folder."""
    jvm = spark._jvm.org.apache.hadoop.fs
    files = jvm.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    (part,) = [f.getPath() for f in files.globStatus(jvm.Path(f"{folder}/part-*"))]
    files.delete(jvm.Path(path), True)
    files.rename(part, jvm.Path(path))
    files.delete(jvm.Path(folder), True)


def write_csv(df: DataFrame, path: str) -> str:
    """One CSV file with a header; numbers and dates as Spark prints them."""
    import csv

    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.DictWriter(f, df.columns)
        out.writeheader()
        out.writerows(rows_of(df))
    return path


def latex_table(df: DataFrame, caption: str = "", label: str = "") -> str:
    """A tabular, in a table with caption and label if either is given; numbers with two decimals."""
    show = lambda v: "" if v is None else f"{v:.2f}" if isinstance(v, float) else latex_escape(str(v))
    kinds = dict(df.dtypes)
    spec = "".join("r" if kinds[c] in ("int", "bigint", "double", "float") else "l" for c in df.columns)
    lines = [rf"\begin{{tabular}}{{{spec}}}", r"\toprule", " & ".join(map(latex_escape, df.columns)) + r" \\", r"\midrule"]
    lines += [" & ".join(show(r[c]) for c in df.columns) + r" \\" for r in rows_of(df)]
    lines += [r"\bottomrule", r"\end{tabular}"]
    if caption or label:
        lines = [r"\begin{table}[htbp]", r"\centering", rf"\caption{{{caption}}}", rf"\label{{{label}}}", *lines, r"\end{table}"]
    return "\n".join(lines) + "\n"


def write_text(path: str, text: str) -> str:
    Path(path).write_text(text, encoding="utf-8")
    return path


def markdown_points(points: DataFrame, title: str) -> str:
    """Discussion points (section, topic, points) under headings."""
    out = [f"# {title}", ""]
    for r in rows_of(points.orderBy("section", "topic")):
        out += [f"## {r['section']}. {r['topic']}", "", *[f"- {' '.join(p.split())}" for p in r["points"]], ""]
    return "\n".join(out)


def network_summary(metrics: DataFrame, clusters: DataFrame) -> DataFrame:
    """(graph, metrics, clusters): a row for each graph with its metrics and its clusters' summaries, nested."""
    m = metrics.select("graph", F.struct(*[c for c in metrics.columns if c != "graph"]).alias("metrics"))
    c = clusters.groupBy("graph").agg(F.sort_array(F.collect_list(F.struct("cluster", *[x for x in clusters.columns if x not in ("graph", "cluster")]))).alias("clusters"))
    return m.join(c, "graph", "left")
