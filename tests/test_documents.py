"""Documents that tasks write, reports of any shape, curves of figures, pairs of crowded documents."""

import json
import math
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from scimap.operators import cooccurrence as co
from scimap.operators import laws, screening, theory
from scimap.sources import documents, files, sinks


@pytest.fixture(scope="module", autouse=True)
def formats(spark):
    documents.register(spark)


def test_latex_in_the_order_of_rows(spark, tmp_path):
    path = f"{tmp_path}/t.tex"
    df = spark.createDataFrame([(i, f"a_{i}", i / 3 if i % 2 else None) for i in range(100)], "k int, name string, x double")
    df.repartition(7).orderBy("k").write.format("latex").mode("overwrite").save(path)
    lines = open(path).read().split("\n")
    assert lines[:4] == [r"\begin{tabular}{rlr}", r"\toprule", r"k & name & x \\", r"\midrule"] and lines[-3:] == [r"\bottomrule", r"\end{tabular}", ""]
    assert lines[4:-3] == [rf"{i} & a\_{i} & {f'{i / 3:.2f}' if i % 2 else ''} \\" for i in range(100)]
    assert lines[:-1] == sinks.latex_table(df.orderBy("k")).split("\n")[:-1]
    with pytest.raises(Exception, match="exists"):
        df.write.format("latex").mode("append").save(path)
    df.where("false").write.format("latex").option("caption", "None").mode("overwrite").save(path)
    assert open(path).read().split("\n")[:3] == [r"\begin{table}[htbp]", r"\centering", r"\caption{None}"]
    assert os.listdir(tmp_path) == ["t.tex"]


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    path = f"{tmp_path}/t.md"
    df = spark.range(100).repartition(4).select("id", F.when(F.col("id") == 50, F.raise_error(F.lit("stop"))).otherwise(F.lit("a|b")).alias("x"))
    with pytest.raises(Exception, match="stop"):
        df.write.format("markdown").mode("overwrite").save(path)
    assert os.listdir(tmp_path) == []
    df.where("id < 2").orderBy("id").write.format("markdown").option("title", "T").mode("overwrite").save(path)
    assert open(path).read() == "# T\n\n| id | x |\n| --- | --- |\n| 0 | a\\|b |\n| 1 | a\\|b |\n"


def test_points_as_markdown(spark, tmp_path):
    points = spark.createDataFrame([(2, "B", ["x  y", "z"]), (1, "A", None)], "section int, topic string, points array<string>")
    points.orderBy("section").write.format("markdown").option("title", "All").mode("overwrite").save(f"{tmp_path}/p.md")
    assert open(f"{tmp_path}/p.md").read() == "# All\n\n## 1. A\n\n\n## 2. B\n\n- x y\n- z\n\n"


def test_reports_of_any_shape(spark, tmp_path):
    for name, data in {
        "a": {"part": [{"x": 1, "y": "s"}, {"x": None, "z": [1]}], "deep": {"er": {"x": 7}}},
        "b": {"part": {"x": 2.5, "y": 3}, "other": 1},
        "c": {"part": "none", "deep": [1]},
        "d": [1, 2],
    }.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(data, indent=1))
    (tmp_path / "bad.json").write_text("{")
    (tmp_path / "no.txt").write_text("{}")
    reports = files.read_reports(spark, str(tmp_path))
    assert {(r["name"], r.null) for r in reports.select("name", F.isnull("report").alias("null")).collect()} == {("a", False), ("b", False), ("c", False), ("d", False), ("bad", True)}
    rows = files.report_part(reports, "part", "x bigint, y string").collect()
    assert sorted(map(tuple, rows), key=str) == sorted([("a", 1, "s"), ("a", None, None), ("b", 2, "3")], key=str)
    assert [tuple(r) for r in files.report_part(reports, "deep.er", "x double").collect()] == [("a", 7.0)]
    assert files.report_part(reports, "missing", "x int").count() == 0


def test_reports_are_written_whole_or_refused(spark, tmp_path):
    a = spark.createDataFrame([(1, None), (2, "é")], "x int, y string")
    sinks.write_reports(str(tmp_path), {"r": {"one": a.orderBy("x"), "none": a.where("false")}})
    assert json.loads((tmp_path / "r.json").read_text()) == {"one": [{"x": 1, "y": None}, {"x": 2, "y": "é"}], "none": []}
    with pytest.raises(Exception, match="more than 1 rows"):
        sinks.write_reports(str(tmp_path), {"r": {"one": a}}, most=1)


def test_curves_meet_their_fits(spark):
    """At the series' own years, each curve is as far from it as its model says."""
    n = [1, 2, 4, 7, 12, 20, 30, 41, 50, 57, 61, 63, 64]
    series = spark.createDataFrame([("c", 2000 + i, x) for i, x in enumerate(n)], "corpus string, year int, n int")
    models = laws.growth_models(series)
    rows = laws.growth_curves(models, series, points=13, ahead=0).collect()
    total, y = 0, []
    for x in n:
        total += x
        y.append(total)
    mean = sum(y) / len(y)
    r2 = {r.model: r.r_squared for r in models.collect()}
    assert len(r2) == 4
    for name, want in r2.items():
        curve = sorted((r.x, r.y) for r in rows if r.model == name)
        assert [x for x, _ in curve] == pytest.approx([2000 + i for i in range(13)])
        assert 1 - sum((a - b) ** 2 for (_, a), b in zip(curve, y, strict=True)) / sum((b - mean) ** 2 for b in y) == pytest.approx(want, abs=1e-6)
    fit = spark.createDataFrame([(2.0, 100.0)], "alpha double, c double")
    line = laws.lotka_line(fit, spark.createDataFrame([(1, 5), (10, 1)], "n_items int, n int"), 3).orderBy("i").collect()
    assert [(r.x, r.y) for r in line] == [pytest.approx(p) for p in ((1, 100), (math.sqrt(10), 10), (10, 1))]


def test_pairs_of_a_crowded_document(spark):
    """5,000 items in one document: pairs of blocks in many tasks, none with more than crowd * crowd pairs."""
    n, crowd = 5000, 512
    items = spark.range(n).select(F.lit(1).alias("doc_id"), F.format_string("i%05d", "id").alias("item"))
    few = spark.createDataFrame([(2, "i00001"), (2, "i00003"), (2, "i00003"), (3, "i00003"), (3, "i00001"), (4, "i00001"), (None, "i00001"), (2, "")], "doc_id int, item string")
    both = items.unionByName(few)
    got = co.pairs(both, crowd=crowd)
    assert got.agg(F.count(F.lit(1)), F.sum("weight")).first()[:] == (n * (n - 1) // 2, n * (n - 1) // 2 + 2)
    assert [r.weight for r in got.where("src = 'i00001' AND dst = 'i00003'").collect()] == [3]
    r = [(d, f"x{k}") for d in range(40) for k in range(d)]
    want = Counter((a, b) for d in range(40) for a in (f"x{k}" for k in range(d)) for b in (f"x{k}" for k in range(d)) if a < b)
    rows = co.pairs(spark.createDataFrame(r, "doc_id int, item string"), 3, crowd=7).collect()
    assert {(x.src, x.dst): x.weight for x in rows} == {p: w for p, w in want.items() if min(sum(int(i[1:]) < d for d in range(40)) for i in p) >= 3}


def test_scores_of_texts_without_a_platform_are_not_computed(spark):
    texts = spark.createDataFrame([(1, "moodle and canvas are useful", 2001, 3), (2, "useful", 2002, 5), (3, None, 2003, 1), (4, "canvas", 2005, 7)], "doc_id int, text string, year int, cited_by int")
    rows = theory.platform_scores(texts, ["moodle", "Canvas"], {"a": ["useful", "easy"]}, {"perceived_usefulness": ["useful"]}, {}).collect()
    got = {r.platform: (r.n_docs, r.a, r.perceived_usefulness, r.mean_year, r.mean_citations, r.total) for r in rows}
    assert got == {"moodle": (1, 0.5, 1.0, 2001, 3, 0.5), "canvas": (2, 0.25, 0.5, 2003, 5, 0.25)}
    assert sorted((r.doc_id, r.platform) for r in screening.platform_mentions(texts, ["moodle", "Canvas"], {}).collect()) == [(1, "canvas"), (1, "moodle"), (4, "canvas")]


def test_a_run_is_cleaned(spark, monkeypatch):
    import os

    from scimap.sources import stores

    monkeypatch.setattr(stores, "RUN", "of-a-test")
    df = stores.checkpointed(spark.range(10))
    assert df.count() == 10 and os.path.isdir(f"{stores.shared_dir(spark)}/scimap-of-a-test".removeprefix("file:"))
    stores.clean(spark)
    assert not os.path.exists(f"{stores.shared_dir(spark)}/scimap-of-a-test".removeprefix("file:"))
