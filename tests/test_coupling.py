"""Coupled documents: pairs stay where they are made, and queries make only what they give."""

import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from scimap.functions.text import reference_key
from scimap.operators import cooccurrence as co
from scimap.plans import outputs
from scimap.sources.stores import spread

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("k", [1, 2, 3])
def test_coupling_of_groups_against_plain_loops(spark, k):
    rnd = random.Random(k)
    rows = [(rnd.choice("ab"), rnd.randrange(40), f"r{min(int(rnd.expovariate(0.1)), 30)}") for _ in range(400)] + [("a", 1, None)]
    of: dict = {}
    for era, doc, ref in rows:
        if ref:
            of.setdefault((era, doc), set()).add(ref)
    want = Counter({(x[0], x[1], y[1]): len(of[x] & of[y]) for x, y in combinations(sorted(of), 2) if x[0] == y[0] and len(of[x] & of[y]) >= k})
    refs = spark.createDataFrame(rows, "era string, doc_id int, ref string")
    got = co.coupling(refs, k, ("era",))
    assert {(r.era, r.src, r.dst): r.weight for r in got.collect()} == want and got.count() == len(want)
    alone = co.coupling(refs.where("era = 'a'"), k)
    assert alone.columns == ["src", "dst", "weight"] and {("a", r.src, r.dst): r.weight for r in alone.collect()} == {p: n for p, n in want.items() if p[0] == "a"}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    # pairs are not aggregated
    assert plan.index("array_intersect") < plan.index("Aggregate")


def test_references_are_read_without_coupling_or_clustering(spark, monkeypatch):
    monkeypatch.setattr(co, "coupling", None)
    assert outputs.rep_coupling_references(spark, SF).count() > 0


def test_sizes_are_counted_without_triangles(spark, monkeypatch):
    monkeypatch.setattr(outputs.reports.graphs, "mean_clustering", None)
    assert outputs.rep_capped_coupling(spark, SF).count() == 3


def test_spread_grows_with_the_input(spark):
    d = spark.read.parquet(f"{SF}/lineitem.parquet")
    assert spread(d, "l_orderkey") is d
    assert spread(d, "l_orderkey", a_task=1 << 10).rdd.getNumPartitions() > 4


def test_reference_keys(spark):
    refs = {"Smith J., A (1990)": "smith_1990", "x, 10.1234/AB.c.": "10.1234/ab.c", "12, No (2001)": None, " van  Eck N., T (1999) 10.5": "van_1999", "No comma (2000)": "no_2000", "": None, "Li, (1990)": None, "A B C, (1991)": "a_1991", None: None}
    d = spark.createDataFrame([(x,) for x in refs], "ref string")
    got = {r.ref: r.key for r in d.select("ref", reference_key(F.col("ref")).alias("key")).collect()}
    assert got == refs
