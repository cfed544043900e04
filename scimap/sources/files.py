"""Report files of any shape as tables, and small files read by the driver."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def primary_file(folder: str, prefer: str = "debiased", pattern: str = "*.csv") -> Path | None:
    """The first file by name, of those whose name contains `prefer` if there are any."""
    files = sorted(Path(folder).glob(pattern))
    return next((f for f in files if prefer in f.name), files[0] if files else None)


def load_thesaurus(path: str) -> tuple[dict[str, str], list[str]]:
    """Synonyms and protected words of a JSON file; none of either if there is no such file."""
    file = Path(path)
    if not file.exists():
        return {}, []
    data = json.loads(file.read_text(encoding="utf-8"))
    return data.get("synonyms", {}), list(data.get("protect_plurals", []))


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """(name, report): the JSON files of a path (a folder or a pattern), each a VARIANT, whatever its shape; name is the
    file's, without .json. Files that are no JSON have a null report."""
    d = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1)
    return d.select(name.alias("name"), F.try_parse_json("value").alias("report"))


def report_part(reports: DataFrame, path: str, schema: str | T.StructType) -> DataFrame:
    """(name, columns of schema): the rows of one part of the reports.

    path: the part's keys, with dots between them, resolved once a report. A part is a list of objects, a row each, or one
    object. Keys that an object doesn't have are null, and so are values that are not of the schema's types; keys that
    the schema doesn't have are left out. Reports without the part have no rows.
    """
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    where = "$" + "".join(f"['{key}']" for key in path.split("."))
    found = F.try_variant_get("report", where, "variant")
    kind = F.schema_of_variant("_part")
    items = F.when(F.startswith(kind, F.lit("ARRAY")), F.try_variant_get("_part", "$", "array<variant>")).when(F.startswith(kind, F.lit("OBJECT")), F.array("_part"))
    rows = reports.select("name", found.alias("_part")).where("_part IS NOT NULL").select("name", F.explode(items).alias("_row"))
    return rows.select("name", *[F.try_variant_get("_row", f"$['{f.name}']", f.dataType.simpleString()).alias(f.name) for f in schema.fields])
