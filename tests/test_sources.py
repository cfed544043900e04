import json

import pytest

from scimap.functions import lexicons
from scimap.operators import figures
from scimap.operators import graphs as gr
from scimap.plans import reports
from scimap.sources import corpus, files, networks, sinks, transcripts

MAP = "﻿id\tlabel\tx\ty\tcluster\tweight<Links>\tweight<Total link strength>\tweight<Occurrences>\tscore<Avg. pub. year>\tscore<Avg. citations>\tscore<Avg. norm. citations>\n1\tgame development\t.5\t.3\t1\t5\t10\t8\t2022\t5.5\t1.2\n2\tunity\t-.2\t.1\t1\t3\t7\t5\t2021\t3.0\t\n3\teducation\t.1\t-.4\t2\t4\t8\t6\n3\teducation again\t.1\t-.4\t2\t4\t8\t6\t\t4.2\t1.0\nbad\trow\t0\t0\t1\t1\t1\t1\n4\tshort\t1\n"
SHIFTED = "id\tlabel\tdescription\turl\tx\ty\tcluster\tweight<Links>\tweight<Total link strength>\tweight<Citations>\n7\tpaper\ttext\t\t0.1\t0.2\t1\t3\t4\t9\n"
NET = "﻿1\t2\t3\n1\t3\t2\n2\t1\t9\n2\t3\nx\ty\tz\n1\t99\t1\n5\n"


@pytest.fixture
def network_files(tmp_path):
    for folder, name, text in (("map", "net_a", MAP), ("map", "net_b", SHIFTED), ("net", "net_a", NET)):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / f"{name}.txt").write_text(text, encoding="utf-8")
    (tmp_path / "net" / "net_b.txt").write_text("﻿", encoding="utf-8")
    return tmp_path


def test_map_and_net_files(spark, network_files):
    nodes = networks.read_maps(spark, f"{network_files}/map")
    rows = {(r.graph, r.node): r for r in nodes.collect()}
    assert set(rows) == {("net_a", 1), ("net_a", 2), ("net_a", 3), ("net_b", 7)}
    assert rows["net_a", 1].mean_year == 2022 and rows["net_a", 2].mean_norm_citations is None
    assert rows["net_a", 3].label == "education again" and rows["net_a", 3].mean_year is None
    shifted = rows["net_b", 7]
    assert (shifted.links, shifted.strength, shifted.occurrences, shifted.mean_year, shifted.mean_citations) == (3, 4, 3, 4.0, 9.0)
    strict = networks.read_maps(spark, f"{network_files}/map/net_b.txt", strict=True).collect()[0]
    assert (strict.links, strict.strength, strict.occurrences, strict.mean_year) == (3, 4, 0, None)
    edges = networks.assemble(nodes, networks.read_nets(spark, f"{network_files}/net"))
    assert sorted(map(tuple, edges.collect())) == [("net_a", 1, 2, 9), ("net_a", 1, 3, 2), ("net_a", 2, 3, 1)]
    one = edges.where("graph = 'net_a'").drop("graph")
    mine = nodes.where("graph = 'net_a'")
    m = gr.network_metrics(mine.select("node"), one, mine.select("node", "cluster")).collect()[0]
    assert (m.n, m.m, m.components, m.diameter, m.density) == (3, 3, 1, 1, 1.0)


CSV = '''﻿Authors,Title,Year,Source title,Cited by,Author Keywords,Affiliations
"Smith, J.; Doe, A.",First,2021,J One,5,"education; game development; Unity","MIT, USA; Oxford, United Kingdom"
"Smith, J.","Second, with ""quotes""
and a line break",2022,J Two,NA,"education;games","MIT, USA"
"Roe, B.",Third,unknown,J One,12.0,,
'''


@pytest.fixture
def export(tmp_path):
    path = tmp_path / "export.csv"
    path.write_text(CSV, encoding="utf-8")
    return str(path)


def test_corpus(spark, export):
    docs = corpus.read_corpus(spark, export)
    rows = {r.title.split(",")[0]: r for r in docs.collect()}
    assert len(rows) == 3 and rows["Second"].title == 'Second, with "quotes"\nand a line break'
    assert [rows[t].cited_by for t in ("First", "Second", "Third")] == [5, 0, 12] and rows["Third"].year is None
    assert rows["First"].abstract is None
    assert {(r.doc_id, r["item"]) for r in corpus.authors(docs).collect()} >= {(rows["First"].doc_id, "Smith, J."), (rows["Third"].doc_id, "Roe, B.")}
    assert sorted(r["item"] for r in corpus.countries(docs).collect()) == ["USA", "USA", "United Kingdom"]
    assert corpus.read_corpus(spark, export, 2021).count() == 1
    assert corpus.references(docs).isEmpty() and corpus.affiliation_triples(docs).isEmpty()


def test_reports_of_a_small_corpus(spark, tmp_path):
    head = "Authors,Title,Year,Source title,Cited by,Author Keywords,Authors with affiliations,References,Abstract\n"
    keys = ["unity; game; education", "Unity; games; learning", "unity3d; game; education", "game; education; learning"]
    refs = ["Smith J., A (2010); Doe A., B (2012)", "Smith J., A (2010)", "Smith J., A (2010); Roe R., C (2015)", "Smith J., A (2010); Roe R., C (2015)"]
    aff = ["Smith, J., MIT, Cambridge, USA; Doe, A., Oxford, Oxford, UK", "Smith, J., MIT, Cambridge, U.S.A.", "Roe, B., Kyiv Univ., Kyiv, Ukraine", ""]
    body = "".join(f'"A{i}; B",T{i},{2016 + 3 * i // 2},S{i % 2},{i},"{keys[i]}","{aff[i]}","{refs[i]}","with unity and chatgpt"\n' for i in range(4))
    path = tmp_path / "c.csv"
    path.write_text(head + body, encoding="utf-8")
    docs = corpus.read_corpus(spark, str(path))
    full = reports.full_analysis(docs)
    assert not [k for k, v in full.items() if isinstance(v, str)]
    for name, report in full.items():
        if name != "sensitivity":
            sinks.write_report(str(tmp_path / f"{name}.json"), report)
    read = lambda name: json.loads((tmp_path / f"{name}.json").read_text(encoding="utf-8"))
    assert {r["node"] for r in read("keyword_network")["nodes"]} == {"unity", "game", "education"}
    eras = {r["era"]: (r["n"], r["m"]) for r in read("coupling")["eras"]}
    assert sum(n for n, _ in eras.values()) == 4
    assert read("lotka")["top_authors"][0] == {"item": "B", "n": 4}
    assert read("lag")["families"] and read("theory")["scores"][0]["platform"] == "unity"
    hhi = {r["kind"]: r["hhi"] for r in read("affiliation")["concentration"]}
    assert hhi["country"] == pytest.approx(0.375)
    raw = {r["form"]: r["n"] for r in read("normalisation")["graphs"]}
    assert raw == {"raw": 2, "canonical": 3} or raw["canonical"] >= raw["raw"]
    assert reports.sensitivity_report(full["keyword_network"]["edges"], replicates=5)["ari"].count() == 5


def test_transcripts(spark, tmp_path):
    text = "[Dr Adams] 10:00:00\nWe use Scopus\nand maps\n\n[Sam] 10:00:20\nok\n\n[Dr Adams] 10:00:40\nfine\n\n[Sam] 10:01:00\nbye\n\n"
    (tmp_path / "2025-12-04.txt").write_text(text, encoding="utf-8")
    m = transcripts.read_transcripts(spark, f"{tmp_path}/*.txt", ["Adams"])
    rows = m.orderBy("seq").collect()
    assert [(r.speaker, r.ts, r.content, r.is_advisor) for r in rows][0] == ("Dr Adams", "10:00:00", "We use Scopus\nand maps", True)
    assert len(rows) == 4 and {r.date for r in rows} == {"2025-12-04"}
    report = reports.chat_report(m, {1: ["maps"]}, {1: ("Maps", "about maps")})
    assert report["transcripts"].collect()[0].minutes == 1.0
    assert "## 1. Maps" in sinks.markdown_points(report["points"], "Points")


def test_files_and_sinks(spark, tmp_path):
    for name in ("b.csv", "a.csv", "z_debiased.csv"):
        (tmp_path / name).write_text("x", encoding="utf-8")
    assert files.primary_file(str(tmp_path)).name == "z_debiased.csv"
    assert files.load_thesaurus(str(tmp_path / "none.json")) == ({}, [])
    df = spark.createDataFrame([("a_b", 1, 0.5), ("c", 2, None)], "name string, n int, v double")
    table = sinks.latex_table(df, "Caption", "tab:x")
    assert r"\caption{Caption}" in table and r"\label{tab:x}" in table and r"a\_b & 1 & 0.50" in table
    with open(sinks.write_csv(df, str(tmp_path / "o.csv")), encoding="utf-8") as f:
        assert f.readline() == "name,n,v\n"
    with pytest.raises(ValueError, match="more than 1 rows"):
        sinks.rows_of(df, 1)
    assert lexicons.SYNONYMS["genai"] == "generative ai"


def test_figures(spark):
    nodes = spark.createDataFrame([("a", 5), ("b", 4), ("c", 1)], "node string, n int")
    edges = spark.createDataFrame([("a", "b", 4), ("a", "c", 1)], "src string, dst string, weight int")
    best, inside = figures.induced(nodes, edges, 2)
    assert [tuple(r) for r in inside.collect()] == [("a", "b", 4)]
    assert figures.tikz_graph(best, inside).count("\\draw") == 1
    n, e = figures.network_plot(nodes.selectExpr("node", "node AS label", "n AS occurrences"), edges)
    assert {r.node: (r.size, r.text) for r in n.collect()}["c"] == (150, None) and {r.width for r in e.collect()} == {3.5, 1.25}
    assert "xbar" in figures.tikz_bars(nodes, "node", "n", "Title") and "loglogaxis" in figures.tikz_lines({"fit": figures.lotka_curve(2, 100, 10)}, "Law", log=True)
