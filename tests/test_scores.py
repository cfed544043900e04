"""Scores of platforms: values that are ranked, and the search for patterns."""

import random

import pytest
from pyspark.sql import functions as F

from scimap.operators import screening, theory

TEXTS = ["the one", "bathe in it", "a the\n", "xéthe b", "the\r\n", "othe ", "", "an idiot", "no-idiot's", "the\n\n", "ends in the\u0085", "\U0001f600the\U0001f600", None]


def test_values_that_differ_when_computed_again_are_ranked_once(spark):
    own = F.udf(lambda i: random.SystemRandom().random() + i, "double").asNondeterministic()
    scores = spark.range(40).select(own("id").alias("total"), F.col("id").alias("mean_year"), own("id").alias("perceived_usefulness"), F.col("id").alias("mean_citations"))
    for test in (theory.score_vs_year, theory.usefulness_vs_citations):
        (row,) = test(scores).collect()
        assert row.n == 40 and row.rho > 0.9


def test_means_are_of_whole_numbers(spark):
    """A third of 3 documents' terms is a third, in whatever order they are summed."""
    texts = spark.createDataFrame([(t, 2000, 1) for t in ("moodle a", "moodle a b", "moodle") * 7], "text string, year int, cited_by int")
    (row,) = theory.platform_scores(texts, ["moodle"], {"x": ["a", "b", "zz"]}, {}, {}).collect()
    assert row.n_docs == 21 and row.x == 21 / (21 * 3)


@pytest.mark.parametrize("pattern", [r"(?:^|[^a-z0-9_])(?:the)(?:$|[^a-z0-9_])", "the$", "^the$", "worthless|idiot", "the.?$", r"\bthe\b", "^$", "(?=the)the"])
def test_patterns_are_found_where_java_finds_them(spark, pattern):
    texts = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")
    want = {r.doc_id for r in texts.where(F.col("text").rlike(pattern)).collect()}
    got = screening.platform_mentions(texts, ["Own"], {"own": pattern})
    assert got.columns == ["doc_id", "text", "platform"]
    assert sorted(r.doc_id for r in got.collect()) == sorted(want)


def test_plain_patterns_leave_java(spark):
    assert [screening.plain_pattern(p) for p in ("(?:^|[^a-z])the", "a|b", r"\bthe", "a.b", "(?<!a)b", "a++", "[a[b]]", "(")] == [True, True, False, False, False, False, False, False]
    d, hits = screening.with_hits(spark.createDataFrame([("the",)], "text string"), ["the", "unity"], {"the": "the$"})
    assert list(hits) == ["the"] and "_hits" in d.columns
