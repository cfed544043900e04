import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from scimap.operators import agreement as ag
from scimap.operators import chat, delphi, graphs, laws, screening, theory, trends
from scimap.operators import communities as cm
from scimap.operators import cooccurrence as co
from scimap.operators import frequency as fr

TRIANGLES = [(a, b, 5) for a, b in ("ab", "ac", "bc", "de", "df", "ef")] + [("c", "d", 1)]


@pytest.fixture
def two_triangles(spark):
    return spark.createDataFrame([("g", *e) for e in TRIANGLES], "graph string, src string, dst string, weight int")


def one(df):
    (row,) = df.collect()
    return row


@pytest.mark.parametrize("algorithm", sorted([*cm.ALGORITHMS, "label_propagation"]))
def test_two_triangles_are_two_clusters(two_triangles, algorithm):
    rows = cm.communities(two_triangles, algorithm).collect()
    found = {}
    for r in rows:
        found.setdefault(r.cluster, set()).add(r.node)
    assert sorted(map(sorted, found.values())) == [list("abc"), list("def")]
    assert sorted(cm.communities(two_triangles, algorithm).collect()) == sorted(rows)


def test_label_propagation_ends_where_no_node_would_change(spark):
    rng = random.Random(5)
    pairs = {tuple(sorted(rng.sample(range(30), 2))) for _ in range(60)}
    edges = [(g, f"n{a:02}", f"n{b:02}", rng.randint(1, 3)) for g in ("g", "h") for a, b in sorted(pairs)]
    df = spark.createDataFrame([*edges, ("g", "own", "own", 2)], "graph string, src string, dst string, weight int")
    rows = cm.propagation(df).collect()
    label = {(r.graph, r.node): r.cluster for r in rows}
    assert len(label) == len(rows) == len({(g, n) for g, a, b, _ in edges for n in (a, b)}) + 1
    about = {}
    for g, a, b, w in edges:
        for x, y in ((a, b), (b, a)):
            sums = about.setdefault((g, x), {})
            sums[label[g, y]] = sums.get(label[g, y], 0) + w
    assert all(sums.get(label[node], 0) == max(sums.values()) for node, sums in about.items())
    for graph in ("g", "h"):
        sizes = Counter(c for (g, _), c in label.items() if g == graph)
        assert sorted(sizes) == list(range(len(sizes))) and [sizes[c] for c in sorted(sizes)] == sorted(sizes.values(), reverse=True)


def test_too_large_a_graph_is_refused(two_triangles):
    with pytest.raises(Exception, match="at most 3"):
        cm.communities(two_triangles, most=3).collect()


def test_betweenness_on_a_path(spark):
    e = spark.createDataFrame([("p", "a", "b", 1), ("p", "b", "c", 1), ("p", "c", "d", 1)], "graph string, src string, dst string, weight int")
    got = {r.node: r.betweenness for r in cm.betweenness(e).collect()}
    assert got == pytest.approx({"a": 0, "b": 2 / 3, "c": 2 / 3, "d": 0})
    again = {r.node: r.betweenness for r in cm.betweenness(e, rows=4).collect()}
    assert again == pytest.approx(got)


def test_bootstrap_and_sweep(two_triangles):
    s = one(cm.stability_summary(cm.bootstrap_stability(two_triangles, 20)))
    assert s.n == 20 and 0 < s.low <= s.mean <= s.high <= 1
    members = cm.sweep(two_triangles, [0.5, 1.0]).select("variant", "node", "cluster")
    assert {r.variant: r.ari for r in ag.against_baseline(members, "1").collect()}["1"] == 1


def test_graph_metrics(spark):
    edges = spark.createDataFrame([(1, 2, 3), (1, 3, 2), (2, 3, 1), (3, 4, 1)], "src int, dst int, weight int")
    nodes = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5)], "node int")
    members = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, 2), (5, 2)], "node int, cluster int")
    m = one(graphs.network_metrics(nodes, edges, members))
    assert (m.n, m.m, m.components, m.diameter) == (5, 4, 2, None)
    assert m.density == 0.4 and m.clustering == pytest.approx((1 + 1 + 1 / 3) / 5)
    assert m.modularity == pytest.approx(3 / 7 - (9 / 14) ** 2 + 1 / 7 - (5 / 14) ** 2)
    four = nodes.where("node < 5")
    assert one(graphs.diameter(four, graphs.reach(four, edges))).diameter == 2
    close = {r.node: r.closeness for r in graphs.closeness(nodes, graphs.reach(nodes, edges)).collect()}
    assert close[3] == pytest.approx(3 / 3 * 3 / 4) and close[5] == 0
    ranks = {r.node: r["rank"] for r in graphs.pagerank(nodes, edges).collect()}
    assert sum(ranks.values()) == pytest.approx(1, abs=1e-4) and max(ranks, key=ranks.get) == 3 or ranks[1] > ranks[4]
    eig = {r.node: r.centrality for r in graphs.eigenvector(nodes, edges).collect()}
    assert math.sqrt(sum(x * x for x in eig.values())) == pytest.approx(1, abs=1e-3) and eig[1] > eig[4] > eig[5]


def test_graph_metrics_of_an_empty_graph(spark):
    nodes = spark.createDataFrame([], "node int")
    edges = spark.createDataFrame([], "src int, dst int, weight int")
    members = spark.createDataFrame([], "node int, cluster int")
    m = one(graphs.network_metrics(nodes, edges, members))
    assert (m.n, m.m, m.density, m.clustering, m.components, m.modularity, m.diameter) == (0, 0, 0, 0, 0, 0, None)


def test_components_of_a_long_path(spark):
    n = 40
    edges = spark.createDataFrame([(i, i + 1, 1) for i in range(n) if i != 20], "src int, dst int, weight int")
    nodes = spark.range(n + 1).select(F.col("id").cast("int").alias("node"))
    got = {r.node: r.component for r in graphs.components(nodes, edges).collect()}
    assert got == {i: 0 if i <= 20 else 21 for i in range(n + 1)}


def test_components_of_a_hub_and_a_path_of_10000(spark, monkeypatch):
    """The rounds of large and small stars grow with the logarithm of the size."""
    rounds, plain = [], graphs.keyed_join
    monkeypatch.setattr(graphs, "keyed_join", lambda *a: rounds.append(1) or plain(*a))
    n = 10_000
    path = spark.range(n - 1).selectExpr("CAST(id * 7919 % 10000 AS INT) AS src", "CAST((id + 1) * 7919 % 10000 AS INT) AS dst")
    hub = spark.range(1, 5000).selectExpr("CAST(20000 + 2500 AS INT) AS src", "CAST(20000 + id AS INT) AS dst")
    edges = path.unionByName(hub).withColumn("weight", F.lit(1))
    nodes = graphs.endpoints(edges).unionByName(spark.createDataFrame([(-5,)], "node int"))
    rows = graphs.components(nodes, edges).groupBy("component").count().collect()
    assert {(r.component, r["count"]) for r in rows} == {(0, n), (20001, 4999), (-5, 1)}
    assert len(rounds) <= 2 * 16


def test_reach_in_batches(spark):
    """Words of sources searched together or one after the other: the same counts, as by a plain search."""
    r = random.Random(3)
    pairs = {tuple(sorted(r.sample(range(150), 2))) for _ in range(170)}
    near = {i: set() for i in range(150)}
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    want = {}
    for s in near:
        d, level = {s: 0}, [s]
        while level:
            level = list({j for i in level for j in near[i]} - set(d))
            d |= dict.fromkeys(level, max(d.values()) + 1)
        want[s] = (len(d), sum(d.values()), max(d.values()))
    edges = spark.createDataFrame([(*p, 1) for p in pairs], "src int, dst int, weight int")
    nodes = spark.range(150).selectExpr("CAST(id AS INT) AS node")
    for rows in (1, 1 << 26):
        got = {x.node: (x.reached, x.total, x.farthest) for x in graphs.reach(nodes, edges, rows).collect()}
        assert got == want


def test_betweenness_of_weighted_graphs(spark):
    """Against shortest paths counted one by one, with ties, several graphs and few sources at a time."""
    r = random.Random(4)
    edges, want = [], {}
    for g in ("x", "y"):
        pairs = {tuple(sorted(r.sample("abcdefghi", 2))): r.choice([1, 1, 2, 3]) for _ in range(16)}
        edges += [(g, a, b, w) for (a, b), w in pairs.items()]
        names = sorted({n for p in pairs for n in p})
        near = {n: [(b if a == n else a, w) for (a, b), w in pairs.items() if n in (a, b)] for n in names}

        def paths(s, t):
            best, found, stack = math.inf, [], [(s, (s,), 0)]
            while stack:
                at, path, d = stack.pop()
                if d > best:
                    continue
                if at == t:
                    best, found = (d, [path]) if d < best else (best, [*found, path])
                    continue
                stack += [(j, (*path, j), d + w) for j, w in near[at] if j not in path]
            return found

        score = dict.fromkeys(names, 0.0)
        for s in names:
            for t in names:
                if s != t and (p := paths(s, t)):
                    for n in names:
                        if n not in (s, t):
                            score[n] += sum(n in x for x in p) / len(p)
        want |= {(g, n): x / ((len(names) - 1) * (len(names) - 2)) for n, x in score.items()}
    e = spark.createDataFrame(edges, "graph string, src string, dst string, weight int")
    for rows in (30, 1 << 26):
        got = {(x.graph, x.node): x.betweenness for x in cm.betweenness(e, rows).collect()}
        assert got == pytest.approx(want)
    with pytest.raises(ValueError, match="positive"):
        cm.betweenness(e.withColumn("weight", F.lit(0)))


def test_rater_pairs_by_bits(spark):
    """More than 64 items, several blocks, missing ratings, raters without common items: as by plain counts."""
    r = random.Random(6)
    rows = [(c, f"r{i}", k, r.randint(1, 5)) for c in "ab" for i in range(9) for k in range(150) if r.random() < 0.4 and (i != 8 or k < 0)]
    rows += [("a", "apart", 999, 5), ("b", "r1", 3, None)]
    df = spark.createDataFrame(rows, "cluster string, rater string, item int, rating int")
    given = {}
    for c, i, k, x in rows:
        if x is not None:
            given.setdefault((c, i), {})[k] = x >= 4
    want = {}
    for c, a in given:
        for d, b in given:
            both = given[c, a].keys() & given[d, b].keys()
            if c == d and a < b and both:
                n = len(both)
                po = sum(given[c, a][k] == given[c, b][k] for k in both) / n
                pa, pb = (sum(given[c, i][k] for k in both) / n for i in (a, b))
                pe = pa * pb + (1 - pa) * (1 - pb)
                want[c, a, b] = (n, 1.0 if pe >= 1 else (po - pe) / (1 - pe))
    for block in (2, 256):
        got = {(x.cluster, x.rater_a, x.rater_b): (x.n, x.kappa) for x in ag.rater_pairs(df, ["cluster"], block=block).collect()}
        assert got.keys() == want.keys()
        assert not [(k, got[k], want[k]) for k in want if got[k] != pytest.approx(want[k])]
        s = {x.cluster: x for x in ag.rater_pair_summary(df, ["cluster"], block=block).collect()}
        for c in "ab":
            k = [v for (d, *_), (_, v) in want.items() if d == c]
            assert (s[c].n_pairs, s[c].mean, s[c].least, s[c].most) == pytest.approx((len(k), sum(k) / len(k), min(k), max(k)))


def test_kendall_by_ranges(spark):
    """Groups of any size: as by all pairs; no window has a whole group."""
    r = random.Random(7)
    rows = [(g, r.randint(0, 30), r.randint(0, 9)) for g in ("a", "b", "b", "b") for _ in range(60)] + [("c", 1, 1)]
    df = spark.createDataFrame(rows, "g string, x int, y int")
    got = {x.g: x.tau for x in ag.kendall(df, ["g"]).collect()}
    for g in "abc":
        own = [(x, y) for h, x, y in rows if h == g]
        sign = lambda v: (v > 0) - (v < 0)
        pairs = [(sign(a[0] - b[0]), sign(a[1] - b[1])) for i, a in enumerate(own) for b in own[:i]]
        root = math.sqrt(sum(x != 0 for x, _ in pairs) * sum(y != 0 for _, y in pairs))
        assert got[g] == pytest.approx(sum(x * y for x, y in pairs) / root if root else 0)
    plan = ag.mean_ranks(df, "x", "rx", ["g"])._jdf.queryExecution().optimizedPlan().toString()
    import re

    windows = re.findall(r"Window \[[^\n]*", plan)
    assert all("_part#" in w or "_p#" in w for w in windows)


def test_adjusted_rand(spark):
    def ari(a, b):
        return one(ag.adjusted_rand(spark.createDataFrame(list(zip(a, b, strict=True)), "a int, b int"))).ari

    assert ari([0, 0, 1, 1, 2, 2], [0, 0, 1, 1, 2, 2]) == ari([0, 0, 1, 1, 2, 2], [5, 5, 3, 3, 4, 4]) == 1
    assert ari([0, 0, 0, 1, 1, 1, 2, 2, 2], [0, 1, 2] * 3) < 0.1
    assert ari([0], [1]) == 1


def test_rank_correlations(spark):
    xy = spark.createDataFrame([(1, 1), (2, 3), (3, 2), (4, 4), (4, 4)], "x int, y int")
    assert one(ag.kendall(xy)).tau == pytest.approx((8 - 1) / math.sqrt(9 * 9))
    assert one(ag.kendall(spark.createDataFrame([(1, 1), (1, 2)], "x int, y int"))).tau == 0
    assert one(ag.spearman(spark.createDataFrame([(1, 9), (2, 5), (3, 1)], "x int, y int"))).rho == pytest.approx(-1)
    assert one(ag.spearman(spark.createDataFrame([(1, 9), (2, 5)], "x int, y int"))).rho == 0


def test_rater_statistics(spark):
    rows = [("c", r, i, v) for r, vs in {"x": [5, 4, 1, 2], "y": [5, 4, 1, 2], "z": [5, 1, 1, 5]}.items() for i, v in enumerate(vs)]
    ratings = spark.createDataFrame(rows, "cluster string, rater string, item int, rating int")
    k = {(r.rater_a, r.rater_b): r.kappa for r in ag.rater_pairs(ratings, ["cluster"]).collect()}
    assert k["x", "y"] == 1 and k["x", "z"] == 0
    same = ratings.where("rater <> 'z'")
    a = one(ag.krippendorff(same, ["cluster"])).alpha
    pairs = [(x, y) for k, (_, _, _, x) in enumerate(rows[:8]) for (_, _, _, y) in rows[k + 1 : 8]]
    assert a == 1 and sum((x - y) ** 2 for x, y in pairs) > 0
    revised = {(r.rater, r.item): r.rating for r in delphi.round_two(ratings.withColumn("round", F.lit(1)), F.lit(0.0)).collect()}
    assert revised["z", 1] == 2 and revised["z", 3] == 4 and revised["x", 0] == 5  # 2.5 and 3.5, half to even


def test_simulated_panel_is_reproducible(spark):
    panel = spark.createDataFrame([(f"E{i}", 3 * i) for i in range(8)], "rater string, experience int")
    clusters = spark.createDataFrame([("C1", 4.6), ("C2", 2.4)], "cluster string, consensus double")
    first, second = (delphi.simulate(panel, clusters, 20) for _ in range(2))
    assert sorted(first["ratings"].collect()) == sorted(second["ratings"].collect())
    assert {r.cluster: r.decision for r in first["decisions"].collect()} == {"C1": "RETAIN", "C2": "REVISE"}
    assert all(r.low <= r.high for r in first["alpha"].collect()) and first["ratings"].where("rating NOT BETWEEN 1 AND 5").isEmpty()


def test_bradford_closes_one_zone_a_source(spark):
    counts = spark.createDataFrame([("a", 90), ("b", 5), ("c", 3), ("d", 2)], "item string, n int")
    zones = {r["item"]: r.zone for r in laws.bradford_zones(counts).collect()}
    assert zones == {"a": 1, "b": 2, "c": 3, "d": 3}


def test_lotka_and_concentration(spark):
    dist = spark.createDataFrame([(k, round(1000 / k**2)) for k in (1, 2, 4, 5)], "n_items int, n int")
    fit = one(laws.lotka(dist))
    assert fit.alpha == pytest.approx(2, abs=0.02) and fit.r_squared > 0.999
    assert one(laws.lotka(dist.limit(1))).alpha is None
    counts = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 2)], "item string, n int")
    assert one(laws.hhi(counts)).hhi == pytest.approx(18 / 64)
    x = [1, 2, 2, 3]
    assert one(laws.gini(counts)).gini == pytest.approx((5 - 2 * sum(sum(x[: i + 1]) for i in range(4)) / 8) / 4)
    none = counts.where("n > 9")
    assert one(laws.hhi(none)).hhi == 0 and one(laws.gini(none)).gini == 0


def test_growth_models_find_their_own_curves(spark):
    rows = []
    before = {}
    for t in range(20):
        for name, y in (("gompertz", 500 * math.exp(-6 * math.exp(-0.3 * t))), ("exponential", 5 * math.exp(0.25 * t))):
            rows.append((name, 2000 + t, y - before.get(name, 0.0)))
            before[name] = y
    rows += [("short", 2000 + t, 1.0) for t in range(3)]
    got = {(r.corpus, r.model): r for r in laws.growth_models(spark.createDataFrame(rows, "corpus string, year int, n double")).collect()}
    assert got["gompertz", "gompertz"].r_squared > 0.9999 and got["gompertz", "gompertz"].asymptote == pytest.approx(500, rel=0.02)
    assert got["exponential", "exponential"].r_squared > 0.9999
    assert not any(c == "short" for c, _ in got)
    counts = [1, 1, 2, 3, 4, 6, 8, 11, 14, 18, 22, 25, 27, 28, 29, 30]
    rows = spark.createDataFrame([("c", 2010 + i, float(n)) for i, n in enumerate(counts)], "corpus string, year int, n double")
    best = [r.model for r in laws.growth_models(rows).collect() if r.best]
    assert len(best) == 1 and best[0] in ("linear", "exponential", "gompertz", "bilogistic")


def test_cooccurrence(spark):
    items = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "a"), (2, "b"), (2, "c"), (3, None), (3, "")], "doc_id int, item string")
    assert sorted(map(tuple, co.pairs(items).collect())) == [("a", "b", 2), ("a", "c", 1), ("b", "c", 1)]
    assert sorted(map(tuple, co.pairs(items, 2).collect())) == [("a", "b", 2)]
    assert sorted(map(tuple, co.nodes_of(items, 2).collect())) == [("a", 2), ("b", 2)]
    refs = spark.createDataFrame([(1, "r"), (1, "r"), (2, "r"), (3, "s"), (2, None)], "doc_id int, ref string")
    assert [tuple(r) for r in co.coupling(refs).collect()] == [(1, 2, 1)]
    merged = spark.createDataFrame([("games", "game"), ("game", "game"), ("unity", "unity")], "raw string, canonical string")
    assert tuple(one(fr.variant_merges(merged))) == ("game", 2, "game|games")


def test_ties_by_first_seen(spark):
    items = spark.createDataFrame([(2, 0, "b"), (1, 1, "c"), (1, 0, "d"), (5, 0, "b")], "doc_id int, pos int, item string")
    assert [r["item"] for r in fr.top_first_seen(items, 2).collect()] == ["b", "d"]


def test_trends(spark):
    rows = [("a", y) for y in (2001, 2002, 2004)] + [("b", 2004), ("b", None)]
    m = trends.item_years(spark.createDataFrame(rows, "item string, year int"))
    assert {(r["item"], r.year): r.n for r in m.collect()} == {("a", 2001): 1, ("a", 2002): 1, ("a", 2004): 1, ("b", 2001): 0, ("b", 2002): 0, ("b", 2004): 1}
    e = {r["item"]: (r.recent, r.prior, r.emergence_index) for r in trends.emergence(m, 1).collect()}
    assert e == {"a": (1, 1, 0), "b": (1, 0, 1)}
    assert {r["item"]: r.prior for r in trends.emergence(m, 2).collect()} == {"a": 0, "b": 0}


def test_screening_and_theory(spark):
    docs = spark.createDataFrame(
        [
            (0, "Teaching with Game Engines", "A game engine course", 2022, 3, ["Unity", "mobile games"], "construct 3"),
            (1, "Other", None, None, 1, ["LLMs"], "we construct things"),
            (2, "", "game design", 2023, 7, None, "scirra"),
        ],
        "doc_id int, title string, abstract string, year int, cited_by int, keywords array<string>, keywords_raw string",
    )
    s = screening.relevance(docs)
    assert [r.doc_id for r in s.where("retained").collect()] == [0]
    assert tuple(one(screening.relevance_report(s))) == (3, 1, 2, 0.3333, 0.6667)
    assert [tuple(r) for r in screening.flagged_titles(s).collect()] == [(1, "Other")]
    assert {r.doc_id for r in screening.in_eras(docs).collect()} == {0, 2}
    lag = {r.family: r.n_keyword_docs for r in screening.family_lag(screening.family_presence(docs)).collect()}
    assert lag == {"mobile": 1, "generative_ai": 1, "immersive_xr": 0, "ai_general": 0}
    t = theory.document_text(docs, ["keywords_raw", "nothing"])
    assert sorted(r.doc_id for r in screening.platform_mentions(t).where("platform = 'construct'").collect()) == [0, 2]
    scores = one(theory.platform_scores(t))
    assert scores.platform == "construct" and scores.n_docs == 2 and scores.mean_citations == 5
    assert one(theory.score_vs_year(theory.platform_scores(t))).rho is None


def test_chat(spark):
    rows = [("d", 0, "Dr Adams", "10:00:00", "Use the Scopus database; МЕТОД"), ("d", 1, "Sam", "10:00:30", "ok unity"), ("d", 2, "Dr Adams", "10:01:00", "Unity карта"), ("e", 0, "Sam", "23:59:00", "x")]
    m = chat.with_role(spark.createDataFrame(rows, "date string, seq int, speaker string, ts string, content string"), ["Adams"])
    stats = {r.date: (r.n, r.n_advisor, r.n_student, r.minutes) for r in chat.transcript_stats(m).collect()}
    assert stats == {"d": (3, 2, 1, 1.0), "e": (1, 0, 1, 0.0)}
    cats = chat.categories(m)
    assert [(r.seq, r.category) for r in cats.orderBy("seq").collect()] == [(0, "Methodology"), (2, "Network Analysis")]
    assert {r.word: r.n for r in chat.theme_counts(m).collect()}["unity"] == 2
    assert one(chat.summary(m)).advisor_ratio == 0.5
    insights = chat.cluster_insights(m, {1: ["unity"], 2: ["nothing"]})
    assert [tuple(r) for r in insights.collect()] == [(1, 1, "[d] Unity карта")]
    points = chat.discussion_points(chat.interpretations(insights, {1: ("T", "about"), 2: ("U", "else")}), cats, chat.theme_counts(m))
    assert [r.section for r in points.orderBy("section").collect()] == [1, 1, 2, 3]
