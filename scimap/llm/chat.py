"""Chat formatting: every participant's view of a dialogue, with loss masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scimap.llm.common import meet, written

#: Messages by these speakers are instructions: they are rendered as such in every view and never learned.
SYSTEM = ("system",)
#: Messages in a range, where segments are cut into parts.
RANGE = 1 << 18


def escaped(text: Column) -> Column:
    """The text without the marks that begin headings and ends."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def in_parts(m: DataFrame, most: int) -> DataFrame:
    """m (conv_id, segment, turn, role, text) with part: 0, but for segments of more than `most` messages, whose messages
    are cut by turn, role and text into parts of `most`.

    The messages of such segments alone are range-partitioned and written in order; a message's place is its row in its
    range, and the segment's rows in the ranges before.
    """
    key = ["conv_id", "segment"]
    n = m.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    crowded = written(n.select(F.col("conv_id").alias("own_conv"), F.col("segment").alias("own_segment"), "n"), small=True)
    rows = crowded.agg(F.sum("n")).first()[0]
    if rows is None:
        return m.withColumn("part", F.lit(0).cast("long"))
    same = F.col("conv_id").eqNullSafe(F.col("own_conv")) & F.col("segment").eqNullSafe(F.col("own_segment"))
    m = meet(m, crowded, same, "left").drop("own_conv", "own_segment")
    order = [*key, "turn", "role", "text"]
    ranges = max(int(m.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // RANGE))
    s = m.where(F.col("n").isNotNull()).repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    s = written(s.select(*order, F.monotonically_increasing_id().alias("at")).withColumn("range", F.shiftright("at", 33)))
    before = Window.partitionBy(*key).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    first = s.groupBy(*key, "range").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    first = first.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    first = written(first.select(F.col("conv_id").alias("own_conv"), F.col("segment").alias("own_segment"), F.col("range").alias("own_range"), "first", "before"), small=True)
    s = meet(s, first, same & (F.col("range") == F.col("own_range")))
    s = s.select(*order, F.floor((F.col("at") - F.col("first") + F.col("before")) / most).cast("long").alias("part"))
    return m.where(F.col("n").isNull()).select(*order, F.lit(0).cast("long").alias("part")).unionByName(s)


def rotate_perspectives(messages: DataFrame, system: tuple[str, ...] = SYSTEM, segment_turns: int = 64, most: int = 1024) -> DataFrame:
    """One view of each conversation for each of its participants (the distinct speakers other than `system`).

    messages: conv_id, turn, role, text; further columns are ignored. In the view of p, p's messages are headed
    <|assistant|> and learned; those of a speaker s other than p are headed <|user:s|>, system messages <|system|>.
    A message is its heading, a line break, its text, <|end|> and a line break. So that no text or name can pass for a
    heading or an end, "<", any number of backslashes and "|" in them get one more backslash before "|"; to read a
    text back, one is taken away. perspective is the name as it is. Columns:

    conv_id, perspective, segment, part, n_messages, dialogue (the rendered part), spans (array of what is learned in it
    as struct<start, end> in characters, end excluded: the text and its <|end|>), n_learned (their characters).

    A segment holds segment_turns successive turn numbers and is one part, 0; if it has more than `most` messages, as
    where turns are null or repeated, it has as many parts of `most`. So a conversation of any length is rendered in
    bounded rows; the whole dialogue is its parts', by segment and part, one after the other. Messages are in order: by
    turn (null first, in a segment of its own, null), role, text. Null roles are a participant named 'unknown'; null texts are empty; null conversations are one conversation; repeated rows are repeated messages.
    A conversation of system messages alone has no participant and so no view. An empty table gives no rows.
    """
    m = messages.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    people = m.where(~F.col("role").isin(*system)).select(F.col("conv_id").alias("_c"), F.col("role").alias("perspective")).distinct()
    m = m.withColumn("segment", F.floor(F.col("turn") / segment_turns).cast("long"))
    # messages are gathered once, and then rendered for each participant: no view is shuffled
    g = in_parts(m, most).groupBy("conv_id", "segment", "part").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("rows"))
    g = g.join(people, g["conv_id"].eqNullSafe(people["_c"])).drop("_c")
    own, by = F.lit("<|assistant|>\n"), F.col("perspective")

    def message(x):
        head = (
            F.when(x["role"].isin(*system), F.lit("<|system|>\n"))
            .when(x["role"] == by, own)
            .otherwise(F.concat(F.lit("<|user:"), escaped(x["role"]), F.lit("|>\n")))
        )
        return F.struct(head.alias("head"), F.concat(escaped(x["text"]), F.lit("<|end|>")).alias("body"))

    g = g.withColumn("rows", F.transform("rows", message))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)").alias("spans"))

    def add(acc, x):
        begin = acc["at"] + F.length(x["head"])
        end = begin + F.length(x["body"])
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        spans = F.when(x["head"] == own, F.concat(acc["spans"], span)).otherwise(acc["spans"])
        return F.struct((end + 1).alias("at"), spans.alias("spans"))

    g = g.withColumn("spans", F.aggregate("rows", start, add, lambda a: a["spans"]))
    return g.select(
        "conv_id",
        "perspective",
        "segment",
        "part",
        F.size("rows").cast("long").alias("n_messages"),
        F.array_join(F.transform("rows", lambda x: F.concat(x["head"], x["body"], F.lit("\n"))), "").alias("dialogue"),
        "spans",
        F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"]).alias("n_learned"),
    )
