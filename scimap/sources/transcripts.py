"""Chat transcripts: text files named by their date, of messages '[Speaker] HH:MM:SS', a line break and text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scimap.functions.text import strip_space
from scimap.operators.chat import with_role

# Fixed value, the format: a message has its speaker, its time and its text, which ends at the next '[' or at the end.
MESSAGE = r"(?s)\[([^\]]+)\]\s+(\d{2}:\d{2}:\d{2})\s*\n(.+?)(?=\[|$)"


def read_transcripts(spark: SparkSession, paths: str | list[str], advisors: list[str]) -> DataFrame:
    """(date, seq, speaker, ts, content, is_advisor): a file's messages in order; date is its name without its ending."""
    date = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1)
    return messages_in(spark.read.text(paths, wholetext=True).select(date.alias("date"), "value"), advisors)


def messages_in(texts: DataFrame, advisors: list[str]) -> DataFrame:
    """The messages, as read_transcripts() gives them, of transcripts that are rows (date, value)."""
    parts = [F.regexp_extract_all("value", F.lit(MESSAGE), F.lit(k)) for k in (1, 2, 3)]
    t = texts.select("date", *[p.alias(n) for p, n in zip(parts, ("speaker", "ts", "content"), strict=True)])
    m = t.select("date", F.posexplode(F.arrays_zip("speaker", "ts", "content")).alias("seq", "m"))
    m = m.select("date", "seq", *[strip_space(F.col(f"m.{n}")).alias(n) for n in ("speaker", "ts", "content")])
    return with_role(m, advisors)
