"""Steps whose tasks grew with the input."""

from pyspark.sql import functions as F

from scimap.operators import agreement as ag
from scimap.operators import cooccurrence as co
from scimap.operators import delphi
from scimap.plans import outputs, reports


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_baseline_is_read_from_one_row_a_node(spark):
    m = spark.createDataFrame([("b", 1, 0), ("b", 2, 0), ("b", 3, 1), ("b", 4, 1), ("x", 1, 5), ("x", 2, 5), ("x", 3, 6), ("y", 1, 0), ("y", 5, None)], "variant string, node int, cluster int")
    got = ag.against_baseline(m, "b")
    assert plan(got).count("LeftOuter") == 0
    rows = {"b": [(0, 0), (0, 0), (1, 1), (1, 1), (-1, -1)], "x": [(0, 5), (0, 5), (1, 6), (1, -1), (-1, -1)], "y": [(0, 0), (0, -1), (1, -1), (1, -1), (-1, -1)]}
    for v, ab in rows.items():
        (want,) = ag.adjusted_rand(spark.createDataFrame(ab, "a int, b int")).collect()
        (row,) = got.where(F.col("variant") == v).collect()
        assert (row.n, round(row.ari, 12)) == (5, round(want.ari, 12))


def test_draws_meet_hashed_ratings(spark):
    r = spark.createDataFrame([("a", i, j, (i * j) % 5 + 1) for i in range(6) for j in range(4)], "cluster string, rater int, item int, rating int")
    got = delphi.bootstrap_alpha(r, 20, 3)
    assert "shuffle_hash" in plan(got)
    (row,) = got.collect()
    of = {x.rater: x.times for x in delphi.multiplicities(r.select("cluster", "rater").distinct(), 20, 3).collect()}
    w = spark.createDataFrame([(str(p), x, times[p]) for x, times in of.items() for p in range(20) if times[p]], "replicate string, rater int, k int")
    each = ag.krippendorff(r.join(w, "rater").select("replicate", "item", "rating", F.explode(F.sequence(F.lit(1), "k"))), ["replicate"])
    low, high = each.agg(F.percentile("alpha", F.lit(0.025)), F.percentile("alpha", F.lit(0.975))).first()
    assert row.replicates == 20 and abs(row.low - low) < 1e-12 and abs(row.high - high) < 1e-12


def test_pairs_of_groups(spark):
    items = spark.createDataFrame([("g", 1, "b"), ("g", 1, "a"), ("g", 2, "a"), ("g", 2, "b"), ("h", 3, "a"), ("h", 3, "b"), ("h", 3, "c"), ("h", 3, "c")], "graph string, doc_id int, item string")
    for crowd in (512, 2):
        assert sorted(map(tuple, co.pairs(items, crowd=crowd, by=("graph",)).collect())) == [("g", "a", "b", 2), ("h", "a", "b", 1), ("h", "a", "c", 1), ("h", "b", "c", 1)]


def test_keywords_bring_their_year(spark):
    d = spark.createDataFrame([(1, 2000, "Games; ;Unity 3D"), (2, None, "x"), (3, 1999, None)], "doc_id long, year int, keywords_raw string")
    got = reports.keyword_items(d)
    assert "Join" not in plan(got)
    assert sorted(map(tuple, got.select("doc_id", "pos", "item", "year").collect())) == [(1, 0, "game", 2000), (1, 1, "unity", 2000), (2, 0, "x", None)]


def test_corpus_is_computed_once(spark, monkeypatch):
    made = []
    monkeypatch.setattr(outputs.ad, "corpus", lambda s, sf, f=outputs.ad.corpus: made.append(1) or f(s, sf))
    for name in ("rep_compare_networks", "join_canonical_labels", "set_common_labels"):
        made.clear()
        assert "lineitem" not in getattr(outputs, name)(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString() and len(made) == 1
