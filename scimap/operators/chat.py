"""Transcripts: statistics, categories, themes and insights. messages: date, seq, speaker, ts ('HH:MM:SS'), content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scimap.functions import lexicons as lex
from scimap.functions.text import contains_any, shortened
from scimap.operators.frequency import top, top_per_group
from scimap.operators.screening import any_term


def with_role(messages: DataFrame, advisors: list[str]) -> DataFrame:
    """messages with is_advisor: whether a name is part of the speaker's."""
    return messages.withColumn("is_advisor", contains_any(F.col("speaker"), advisors))


def transcript_stats(messages: DataFrame) -> DataFrame:
    """(date, n, n_advisor, n_student, minutes): minutes from the first message to the last in their order, negative past midnight."""
    at = F.unix_timestamp(F.concat(F.lit("2000-01-01 "), "ts"))
    m = messages.withColumn("at", at)
    return m.groupBy("date").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("is_advisor").alias("n_advisor"),
        F.count_if(~F.col("is_advisor")).alias("n_student"),
        ((F.max_by("at", "seq") - F.min_by("at", "seq")) / 60).alias("minutes"),
    )


def categories(messages: DataFrame, patterns: list[tuple[str, str]] = lex.CATEGORY_PATTERNS, n: int = 300) -> DataFrame:
    """(date, seq, category, excerpt): advisors' messages by the first pattern that matches; others have no row."""
    c = F.lit(None).cast("string")
    for pattern, name in reversed(patterns):
        c = F.when(F.col("content").rlike(f"(?iu){pattern}"), F.lit(name)).otherwise(c)
    m = messages.where("is_advisor").withColumn("category", c).where("category IS NOT NULL")
    return m.select("date", "seq", "category", F.substring("content", 1, n).alias("excerpt"))


def category_counts(categorised: DataFrame) -> DataFrame:
    return categorised.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def theme_counts(messages: DataFrame, words: list[str] = lex.TOPIC_WORDS) -> DataFrame:
    """(word, n): messages that contain the word as a substring, in one scan; words without any have no row."""
    text = F.lower("content")
    found = F.filter(F.array(*[F.lit(w) for w in dict.fromkeys(words)]), lambda w: F.contains(text, w))
    return messages.select(F.explode(found).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def top_themes(counts: DataFrame, k: int = 10) -> DataFrame:
    return top(counts, k, F.col("n").desc(), F.col("word"))


def cluster_insights(messages: DataFrame, clusters: dict[int, list[str]], k: int = 5, n: int = 200) -> DataFrame:
    """(cluster, rank, insight): the first k advisors' messages about each cluster's keywords, as '[date] text'."""
    found = F.array_compact(F.array(*[F.when(F.col("content").rlike(f"(?iu){any_term(words)}"), F.lit(c)) for c, words in clusters.items()]))
    m = messages.where("is_advisor").withColumn("cluster", F.explode(found))
    m = m.withColumn("insight", F.concat(F.lit("["), "date", F.lit("] "), shortened(F.col("content"), n)))
    return top_per_group(m, ["cluster"], k, F.col("date"), F.col("seq")).select("cluster", "rank", "insight")


def summary(messages: DataFrame) -> DataFrame:
    """One row: messages, transcripts, advisors' messages and their share (0 for none)."""
    n = F.count(F.lit(1))
    return messages.agg(
        n.alias("n_messages"),
        F.countDistinct("date").alias("n_transcripts"),
        F.count_if("is_advisor").alias("n_advisor"),
        F.coalesce(F.try_divide(F.count_if("is_advisor"), n), F.lit(0.0)).alias("advisor_ratio"),
    )


def interpretations(insights: DataFrame, themes: dict[int, tuple[str, str]]) -> DataFrame:
    """(cluster, theme, description, insights): each cluster's theme with its insights, in order; themes without any have none."""
    rows = insights.sparkSession.createDataFrame([(c, *t) for c, t in themes.items()], "cluster int, theme string, description string")
    g = insights.groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("rank", "insight"))).alias("i"))
    return rows.join(g, "cluster", "left").select("cluster", "theme", "description", F.coalesce("i.insight", F.array().cast("array<string>")).alias("insights"))


def discussion_points(interpreted: DataFrame, categorised: DataFrame, themes: DataFrame, method: tuple[str, ...] = ("Methodology", "Database Usage", "Search Strategy"), k: int = 10) -> DataFrame:
    """(section, topic, points): one for each cluster, one on methods if any message is about them, one of the top themes."""
    clusters = interpreted.select(F.lit(1).alias("section"), F.col("theme").alias("topic"), "insights")
    m = top(categorised.where(F.col("category").isin(*method)), k, F.col("date"), F.col("seq"))
    m = m.agg(F.sort_array(F.collect_list(F.struct("date", "seq", "excerpt"))).alias("x")).where("size(x) > 0")
    t = top_themes(themes, k).agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "word"))).alias("x")).where("size(x) > 0")
    m = m.select(F.lit(2).alias("section"), F.lit("Methods").alias("topic"), F.col("x.excerpt").alias("insights"))
    t = t.select(F.lit(3).alias("section"), F.lit("Themes").alias("topic"), F.col("x.word").alias("insights"))
    return clusters.unionByName(m).unionByName(t).withColumnRenamed("insights", "points")
