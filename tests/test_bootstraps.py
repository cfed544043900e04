"""Registered bootstraps draw as many replicates as their operators and the reference: 500 and 300."""

import hashlib

from scimap.operators import delphi
from scimap.plans import registry, statistics

SF = "/root/testdata/sf0.001"


def test_stability_has_500_replicates(spark):
    rows = registry.QUERIES["stat_bootstrap_stability"](spark, SF).collect()
    assert rows and {r.n for r in rows} == {500}


def test_alpha_has_300_replicates(spark):
    rows = delphi.bootstrap_alpha(statistics._ratings(spark, SF)).collect()
    assert rows and {r.replicates for r in rows} == {300}


def test_multiplicities(spark):
    """Every replicate has as many seats as there are raters, each fixed by its digest."""
    raters = [("a", f"r{i}") for i in range(7)] + [("b", "alone")]
    rows = delphi.multiplicities(spark.createDataFrame(raters, "cluster string, rater string"), 20, 5).collect()
    assert {(r.cluster, r.rater) for r in rows} <= set(raters)
    for p in range(20):
        seats = [int(hashlib.md5(f"5:a:{p + 1}:{seat}".encode()).hexdigest()[:8], 16) % 7 for seat in range(7)]
        assert {r.rater: r.times[p] for r in rows if r.cluster == "a"} == {f"r{i}": seats.count(i) for i in range(7)}
        assert [r.times[p] for r in rows if r.cluster == "b"] == [1]
