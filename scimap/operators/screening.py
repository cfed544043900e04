"""Filters and rule-based classification of documents by term lists and patterns."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scimap.functions import lexicons as lex
from scimap.functions.text import canonical_keyword, contains_any, joined_text, platform_pattern
from scimap.operators.frequency import top


def up_to_year(docs: DataFrame, cap: int) -> DataFrame:
    """Documents up to a year; those without one go."""
    return docs.where(F.col("year") <= cap)


def in_eras(docs: DataFrame, eras: list[tuple] = lex.ERAS) -> DataFrame:
    """docs with era, a row for each era that holds its year (both ends included, None is open)."""

    def inside(first, last):
        both = F.lit(True)
        if first is not None:
            both = both & (F.col("year") >= first)
        if last is not None:
            both = both & (F.col("year") <= last)
        return F.coalesce(both, F.lit(False))

    names = F.array_compact(F.array(*[F.when(inside(a, b), F.lit(name)) for name, a, b in eras]))
    return docs.withColumn("era", F.explode(names))


def any_term(terms: list[str]) -> str:
    """A pattern that finds any of the terms as a substring."""
    return "|".join(re.escape(t) for t in terms)


def relevance(docs: DataFrame, one: list[str] = lex.EDUCATION_TERMS, two: list[str] = lex.GAME_TERMS) -> DataFrame:
    """docs with retained: whether title and abstract have a term of either list; null fields are empty."""
    text = joined_text(F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit("")))
    return docs.withColumn("retained", text.rlike(any_term(one)) & text.rlike(any_term(two)))


def relevance_report(screened: DataFrame) -> DataFrame:
    """One row: total, retained and flagged documents and their rates to 4 places; null rates for no documents."""
    n, kept = F.count(F.lit(1)), F.count_if("retained")
    rate = lambda x: F.round(F.try_divide(x, n), 4)
    return screened.agg(n.alias("total"), kept.alias("n_retained"), (n - kept).alias("n_flagged"), rate(kept).alias("retained_rate"), rate(n - kept).alias("flagged_rate"))


def flagged_titles(screened: DataFrame, k: int = 15) -> DataFrame:
    """The first k non-empty titles, by document, of those that are not retained."""
    return top(screened.where("NOT retained AND title <> ''").select("doc_id", "title"), k, F.col("doc_id"))


def family_presence(docs: DataFrame, families: dict[str, list[str]] = lex.TERM_FAMILIES) -> DataFrame:
    """(doc_id, year, family, in_keywords, in_abstract): a row for each document and family.

    Keywords (array<string>) are compared in canonical form; the abstract has a term if it is a substring.
    """
    keywords = F.transform(F.coalesce("keywords", F.array().cast("array<string>")), lambda x: canonical_keyword(x))
    rows = [
        F.struct(
            F.lit(name).alias("family"),
            F.arrays_overlap(keywords, F.array(*[canonical_keyword(F.lit(t)) for t in terms])).alias("in_keywords"),
            contains_any(F.lower("abstract"), terms).alias("in_abstract"),
        )
        for name, terms in families.items()
    ]
    return docs.select("doc_id", "year", F.inline(F.array(*rows)))


def family_lag(presence: DataFrame, recent: int = 2022) -> DataFrame:
    """(family, n_keyword_docs, n_abstract_docs, n_recent_abstract_docs) of family_presence()."""
    return presence.groupBy("family").agg(
        F.count_if("in_keywords").alias("n_keyword_docs"),
        F.count_if("in_abstract").alias("n_abstract_docs"),
        F.count_if(F.col("in_abstract") & (F.col("year") >= recent)).alias("n_recent_abstract_docs"),
    )


def family_by_year(presence: DataFrame) -> DataFrame:
    """(family, year, n): documents whose abstract has the family, by year."""
    return presence.where("in_abstract AND year IS NOT NULL").groupBy("family", "year").agg(F.count(F.lit(1)).alias("n"))


#: What Java's patterns and those of pyarrow (RE2) may read differently: escapes, dots, look-around, possessive quantifiers, nested classes.
_DIFFERS = re.compile(r"\\|\.|\(\?(?!:)|[+*?}]\+|&&|\[[^]]*\[")


def plain_pattern(pattern: str) -> bool:
    """Whether pyarrow finds the pattern where Java does: see _DIFFERS."""
    if _DIFFERS.search(pattern):
        return False
    try:
        pc.match_substring_regex(pa.array([""]), pattern)
    except pa.ArrowInvalid:
        return False
    return True


def _matches(text: pa.Array, pattern: str) -> np.ndarray:
    """Whether each text has the pattern. '$' also stands before a line terminator at the end, as in Java."""
    hit = pc.fill_null(pc.match_substring_regex(text, pattern), False).to_numpy(zero_copy_only=False)
    if "$" in pattern:
        ends = pc.fill_null(pc.match_substring_regex(text, r"[\n\r\x{85}\x{2028}\x{2029}]\z"), False)
        cut = pc.replace_substring_regex(text.filter(ends), r"(?:\r\n|[\n\r\x{85}\x{2028}\x{2029}])\z", "")
        ends = ends.to_numpy(zero_copy_only=False)
        hit = hit.copy()
        hit[ends] |= pc.match_substring_regex(cut, pattern).to_numpy(zero_copy_only=False)
    return hit


def with_hits(texts: DataFrame, platforms: list[str], patterns: dict[str, str] | None = None) -> tuple[DataFrame, dict[str, Column]]:
    """texts with what pyarrow finds, and by platform the column that tells it: for platforms with plain patterns of
    their own, which Java's engine takes about 50 times as long to look for."""
    own = lex.PLATFORM_PATTERNS if patterns is None else patterns
    names = [n for n in dict.fromkeys(p.lower().strip() for p in platforms) if n in own and plain_pattern(own[n])]
    if not names:
        return texts, {}
    plain = [own[n] for n in names]

    @F.arrow_udf("array<boolean>")
    def hits(text: pa.Array) -> pa.Array:
        flat = np.stack([_matches(text, p) for p in plain], axis=1).ravel()
        return pa.ListArray.from_arrays(pa.array(np.arange(len(text) + 1, dtype=np.int32) * len(plain)), pa.array(flat))

    return texts.withColumn("_hits", hits("text")), {n: F.col("_hits")[i] for i, n in enumerate(names)}


def mentioned(text: Column, platforms: list[str], patterns: dict[str, str] | None = None, hits: dict[str, Column] | None = None) -> Column:
    """The platforms (in lower case) that a text in lower case mentions. Patterns made of a name are tried where the name
    is. hits: see with_hits()."""
    own = lex.PLATFORM_PATTERNS if patterns is None else patterns

    def found(name: str) -> Column:
        pattern = platform_pattern(name, patterns)
        name = name.lower().strip()
        if hits and name in hits:
            return hits[name]
        hit = text.rlike(pattern)
        return hit if name in own else text.contains(name) & hit

    return F.array_compact(F.array(*[F.when(found(p), F.lit(p.lower())) for p in platforms]))


def platform_mentions(texts: DataFrame, platforms: list[str] = lex.PLATFORMS, patterns: dict[str, str] | None = None) -> DataFrame:
    """texts' rows once for each platform that their text (lower case) mentions, with column platform: one scan for all.

    A lambda's argument is evaluated once, however many patterns look at it; an outer explode() keeps the optimizer from
    searching the text a second time, in a filter for texts that mention none.
    """
    d, hits = with_hits(texts, platforms, patterns)
    found = F.transform(F.array("text"), lambda t: mentioned(t, platforms, patterns, hits))[0]
    return d.withColumn("platform", F.explode_outer(found)).where("platform IS NOT NULL").drop("_hits")
