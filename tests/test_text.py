import pytest
from pyspark.sql import functions as F

from scimap.functions import text as tx


def values(spark, rows, f):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_canonical_keyword(spark):
    raw = ["Serious Games", "GAMES", "educational games", "Computer Graphics", "ethics", "Unity3D", "GenAI", "", "  “Game  engines.” ", None]
    want = ["serious game", "game", "educational game", "computer graphics", "ethics", "unity", "generative ai", "", "game engine", None]
    assert values(spark, raw, tx.canonical_keyword) == want


def test_singular(spark):
    assert values(spark, ["studies", "ties", "boxes", "courses", "class", "gas", "cats"], tx.singular) == ["study", "tie", "box", "cours", "class", "gas", "cat"]


def test_country(spark):
    raw = ["USA", "U.S.A.", "united states", "UK", "Britain", "Brazil", " Viet Nam. "]
    assert values(spark, raw, tx.normalise_country) == ["United States"] * 3 + ["United Kingdom"] * 2 + ["Brazil", "Vietnam"]


@pytest.mark.parametrize(
    ("ref", "key"),
    [
        ("Smith J., A title (2010) Journal", "smith_2010"),
        ("Doe A., X, doi:10.1234/ABC.9.,", "10.1234/abc.9"),
        ("van Eck N. (2001), (2005)", "van_2001"),
        ("12, (2001)", None),
        ("123, (2001)", None),
        ("No year here", None),
        ("", None),
    ],
)
def test_reference_key(spark, ref, key):
    assert values(spark, [ref], tx.reference_key) == [key]


def test_affiliations_and_fields(spark):
    raw = "Smith, John, MIT, Cambridge, USA; Short, Entry; Doe, Jane, Oxford, Oxford, U.K."
    (found,) = values(spark, [raw], tx.affiliations)
    assert [tuple(x) for x in found] == [("Smith, John", "MIT", "United States"), ("Doe, Jane", "Oxford", "United Kingdom")]
    assert values(spark, ["a; ;b;; c ", None, ""], tx.split_field) == [["a", "b", "c"], [], []]
    assert values(spark, ["Dept, MIT, USA; none; A, UK"], tx.simple_countries) == [["USA"]]


def test_platform_pattern_and_latex():
    import re

    assert not re.search(tx.platform_pattern("construct"), "we construct games")
    assert re.search(tx.platform_pattern("construct"), "with construct 3")
    assert re.search(tx.platform_pattern("unity"), "the unity engine") and not re.search(tx.platform_pattern("unity"), "community")
    assert tx.latex_escape("a_b & 5%") == r"a\_b \& 5\%"
