"""Tables as LaTeX or Markdown documents: data sources that Spark's tasks write, one file in the end.

Each task writes its rows as lines of its own part, beside the document; when all tasks are through, the parts are put
together in the order of the partitions, between what stands before and after the rows. A write that fails leaves no
document. Rows are never on the driver, which copies bytes. Paths are of any store that pyarrow knows.

    documents.register(spark)
    df.orderBy("n").write.format("latex").option("caption", "Sources").mode("overwrite").save(path)
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import NumericType, StructType

from scimap.functions.text import latex_escape


@dataclass
class Part(WriterCommitMessage):
    partition: int
    name: str


class _Lines(DataSourceWriter):
    """Rows as lines; head and foot stand about them."""

    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        if "path" not in options:
            raise ValueError("a path must be given")
        self.options, self.schema, self.overwrite = options, schema, overwrite
        self.staging = f"{options['path']}.parts-{uuid.uuid4().hex}"

    def head(self) -> list[str]:
        return []

    def foot(self) -> list[str]:
        return []

    def line(self, row: Row) -> str:
        raise NotImplementedError

    def write(self, iterator: Iterator[Row]) -> Part:
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(_uri(self.staging))
        files.create_dir(base, recursive=True)
        partition, name = TaskContext.get().partitionId(), uuid.uuid4().hex
        with files.open_output_stream(f"{base}/{name}") as out:
            for row in iterator:
                out.write((self.line(row) + "\n").encode())
        return Part(partition, name)

    def commit(self, messages: list[Part | None]) -> None:
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(_uri(self.staging))
        _, path = fs.FileSystem.from_uri(_uri(self.options["path"]))
        if not self.overwrite and files.get_file_info(path).type != fs.FileType.NotFound:
            files.delete_dir(base)
            raise ValueError(f"{path} exists")
        with files.open_output_stream(f"{path}.new") as out:
            out.write("".join(x + "\n" for x in self.head()).encode())
            for part in sorted((m for m in messages if m), key=lambda m: m.partition):
                with files.open_input_stream(f"{base}/{part.name}") as own:
                    while data := own.read(1 << 20):
                        out.write(data)
            out.write("".join(x + "\n" for x in self.foot()).encode())
        if files.get_file_info(path).type != fs.FileType.NotFound:
            files.delete_file(path)
        files.move(f"{path}.new", path)
        files.delete_dir(base)

    def abort(self, messages: list[Part | None]) -> None:
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(_uri(self.staging))
        if files.get_file_info(base).type != fs.FileType.NotFound:
            files.delete_dir(base)


def _uri(path: str) -> str:
    return path if ":" in path.split("/")[0] else f"file://{path}"


class LatexLines(_Lines):
    """A tabular, in a table with caption and label if either is given; numbers with two decimals, null empty."""

    def head(self) -> list[str]:
        spec = "".join("r" if isinstance(f.dataType, NumericType) else "l" for f in self.schema.fields)
        lines = [rf"\begin{{tabular}}{{{spec}}}", r"\toprule", " & ".join(latex_escape(f.name) for f in self.schema.fields) + r" \\", r"\midrule"]
        if self.titled:
            lines = [r"\begin{table}[htbp]", r"\centering", rf"\caption{{{self.options.get('caption', '')}}}", rf"\label{{{self.options.get('label', '')}}}", *lines]
        return lines

    @property
    def titled(self) -> bool:
        return bool(self.options.get("caption") or self.options.get("label"))

    def foot(self) -> list[str]:
        return [r"\bottomrule", r"\end{tabular}"] + [r"\end{table}"] * self.titled

    def line(self, row: Row) -> str:
        return " & ".join("" if v is None else f"{v:.2f}" if isinstance(v, float) else latex_escape(str(v)) for v in row) + r" \\"


class MarkdownLines(_Lines):
    """With columns section, topic and points (array of strings), headings with lists; else a table. title: a first heading."""

    @property
    def listed(self) -> bool:
        return {"section", "topic", "points"} <= set(self.schema.names)

    def head(self) -> list[str]:
        title = [f"# {self.options['title']}", ""] if self.options.get("title") else []
        return title if self.listed else [*title, "| " + " | ".join(self.schema.names) + " |", "|" + " --- |" * len(self.schema.names)]

    def line(self, row: Row) -> str:
        if self.listed:
            return "\n".join([f"## {row['section']}. {row['topic']}", "", *[f"- {' '.join(p.split())}" for p in row["points"] or []], ""])
        return "| " + " | ".join("" if v is None else f"{v:.2f}" if isinstance(v, float) else " ".join(str(v).replace("|", r"\|").split()) for v in row) + " |"


class Latex(DataSource):
    @classmethod
    def name(cls) -> str:
        return "latex"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return LatexLines(dict(self.options), schema, overwrite)


class Markdown(DataSource):
    @classmethod
    def name(cls) -> str:
        return "markdown"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return MarkdownLines(dict(self.options), schema, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the formats latex and markdown known to the session."""
    spark.dataSource.register(Latex)
    spark.dataSource.register(Markdown)
