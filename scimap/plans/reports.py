"""Composite analyses of a corpus: each gives the DataFrames of one report by name.

A corpus is rows of scimap.sources.corpus.read_corpus. Columns that an export lacks are null, so every report exists
and is empty where its input is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scimap.functions import lexicons as lex
from scimap.functions.text import canonical_keyword, plain_keyword, reference_key, split_field
from scimap.operators import agreement, chat, communities, graphs, laws, screening, theory, trends
from scimap.operators import cooccurrence as co
from scimap.operators import frequency as fr
from scimap.sources import corpus as src
from scimap.sources.stores import checkpointed

Report = dict[str, DataFrame]
ALGORITHMS = ("louvain", "leiden", "greedy", "label_propagation", "map_equation")


def keyword_items(docs: DataFrame, canonical: bool = True, column: str = "keywords_raw") -> DataFrame:
    """(doc_id, pos, item, year): keywords in canonical form, or stripped and in lower case."""
    k = docs.select("doc_id", "year", F.posexplode(split_field(F.col(column))).alias("pos", "item"))
    form = canonical_keyword(F.col("item")) if canonical else plain_keyword(F.col("item"))
    # an outer explode() keeps the optimizer from computing the form a second time, in the filter
    return k.select("doc_id", "pos", F.explode_outer(F.array(form)).alias("item"), "year").where("item <> ''")


def keyword_network(docs: DataFrame, min_docs: int = 3, canonical: bool = True) -> Report:
    """Nodes (node, n) and edges (src, dst, weight) of keywords in at least min_docs documents."""
    items = checkpointed(keyword_items(docs, canonical).select("doc_id", "item"))
    return {"nodes": checkpointed(co.nodes_of(items, min_docs)), "edges": checkpointed(co.pairs(items, min_docs))}


def affiliation_report(docs: DataFrame) -> Report:
    t = checkpointed(src.affiliation_triples(docs))
    countries = t.select("doc_id", F.col("country").alias("item"))
    institutions = t.select("doc_id", F.col("institution").alias("item"))
    best = lambda x: fr.top(fr.document_frequency(x), 10, F.col("n").desc(), F.col("item"))
    return {"concentration": laws.concentration(countries, institutions), "top_countries": best(countries), "top_institutions": best(institutions), "collaboration": co.collaboration(countries)}


def era_references(docs: DataFrame, eras: list[tuple] = lex.ERAS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, era) and (doc_id, era, ref), of the columns that they need, computed once."""
    d = checkpointed(screening.in_eras(docs, eras).select("doc_id", "era", "references_raw"))
    refs = d.select("doc_id", "era", F.explode(split_field(F.col("references_raw"))).alias("ref"))
    return d.select("doc_id", "era"), checkpointed(refs.select("doc_id", "era", reference_key(F.col("ref")).alias("ref")).where("ref IS NOT NULL"))


def era_sizes(in_era: DataFrame, refs: DataFrame, min_shared: int = 1) -> DataFrame:
    """(era, n, m, density): documents of each era, its coupled pairs and their share of all; pairs are counted where they are made."""
    sizes = in_era.groupBy("era").agg(F.count(F.lit(1)).alias("n"))
    m = co.coupling(refs, min_shared, ("era",)).groupBy("era").agg(F.count(F.lit(1)).alias("m"))
    density = F.coalesce(F.try_divide(2 * F.coalesce("m", F.lit(0)), F.col("n") * (F.col("n") - 1)), F.lit(0.0))
    return sizes.join(m, "era", "left").select("era", "n", F.coalesce("m", F.lit(0)).alias("m"), density.alias("density"))


def coupling_report(docs: DataFrame, eras: list[tuple] = lex.ERAS, min_shared: int = 1) -> Report:
    """Each era's coupling graph: its documents and edges, density, weighted clustering, the 10 most coupled documents;
    the correlation of cited references between eras and the most cited of each. A document's repeated references
    count in the latter, not in coupling."""
    in_era, refs = era_references(docs, eras)
    summary, coupled = None, None
    for name, _, _ in eras:
        nodes = in_era.where(F.col("era") == name).select(F.col("doc_id").alias("node"))
        edges = checkpointed(co.coupling(refs.where(F.col("era") == name), min_shared))
        row = graphs.density(nodes, edges).crossJoin(graphs.mean_clustering(nodes, edges, weighted=True)).withColumn("era", F.lit(name))
        best = fr.top(graphs.degrees(nodes, edges), 10, F.col("strength").desc(), F.col("node")).withColumn("era", F.lit(name))
        summary, coupled = (row, best) if summary is None else (summary.unionByName(row), coupled.unionByName(best))
    counts = refs.groupBy("era", "ref").agg(F.count(F.lit(1)).alias("n"))
    return {"eras": summary, "most_coupled": coupled, "kendall": agreement.era_correlation(counts), "top_references": co.top_references(refs)}


def named(edges: DataFrame, graph: str) -> DataFrame:
    return edges.withColumn("graph", F.lit(graph))


def sensitivity_report(edges: DataFrame, resolutions: tuple[float, ...] = (0.5, 0.75, 1.0, 1.25, 1.5), replicates: int = 500, seed: int = 42) -> Report:
    """Partitions at each resolution against that at 1, stability under resampled edges, agreement of algorithms."""
    e = named(edges, "keywords")
    members = checkpointed(communities.sweep(e, list(resolutions), seed).select("variant", "node", "cluster"))
    other = None
    for name in ALGORITHMS:
        m = communities.communities(e, name, seed=seed).select(F.lit(name).alias("variant"), "node", "cluster")
        other = m if other is None else other.unionByName(m)
    other = checkpointed(other)
    sizes = other.groupBy("variant").agg(F.countDistinct("cluster").alias("n_clusters"))
    quality = None
    for name in ALGORITHMS:
        q = graphs.modularity(edges, other.where(F.col("variant") == name).select("node", "cluster")).withColumn("variant", F.lit(name))
        quality = q if quality is None else quality.unionByName(q)
    boot = communities.stability_summary(communities.bootstrap_stability(e, replicates, seed=seed))
    return {
        "ari": agreement.against_baseline(members, "1"),
        "jaccard": agreement.stability(members, "1"),
        "algorithms": sizes.join(quality, "variant").join(agreement.against_baseline(other, "louvain"), "variant"),
        "bootstrap": boot,
    }


def minimum_sweep(docs: DataFrame, minima: tuple[int, ...] = (2, 3, 5, 10), seed: int = 42) -> DataFrame:
    """(variant, node, cluster): Louvain of the keyword graph at each minimum of documents; graphs of fewer than 3 nodes have no rows."""
    edges = None
    for k in minima:
        g = keyword_network(docs, k)
        many = g["nodes"].agg((F.count(F.lit(1)) >= 3).alias("_many"))
        e = named(g["edges"], str(k)).crossJoin(many).where("_many").drop("_many")
        edges = e if edges is None else edges.unionByName(e)
    return communities.communities(edges, "louvain", seed=seed).select(F.col("graph").alias("variant"), "node", "cluster")


def shared_labels(raw: DataFrame, canonical: DataFrame) -> DataFrame:
    """(raw, node): raw labels (node) with the node of the canonical graph that their form is."""
    return raw.select(F.col("node").alias("raw"), canonical_keyword(F.col("node")).alias("node")).join(canonical.select("node"), "node").select("raw", "node")


def normalisation_report(docs: DataFrame, min_docs: int = 3, seed: int = 42) -> Report:
    """What canonical forms change: nodes and edges of both graphs, merged variants, agreement of their partitions."""
    docs = checkpointed(docs.select("doc_id", "year", "keywords_raw"))
    raw, own = keyword_network(docs, min_docs, canonical=False), keyword_network(docs, min_docs)
    rows = None
    for name, g in (("raw", raw), ("canonical", own)):
        r = graphs.density(g["nodes"], g["edges"]).withColumn("form", F.lit(name))
        rows = r if rows is None else rows.unionByName(r)
    k = src.keywords(docs).select(plain_keyword(F.col("item")).alias("raw"), canonical_keyword(F.col("item")).alias("canonical"))
    members = communities.communities(named(raw["edges"], "raw").unionByName(named(own["edges"], "canonical")), "louvain", seed=seed)
    a = members.where("graph = 'raw'").select(canonical_keyword(F.col("node")).alias("node"), F.col("cluster").alias("a"))
    b = members.where("graph = 'canonical'").select("node", F.col("cluster").alias("b"))
    return {"graphs": rows, "merges": fr.variant_merges(k), "ari": agreement.adjusted_rand(a.join(b, "node").select("a", "b"))}


def theory_report(docs: DataFrame, nodes: DataFrame, edges: DataFrame, platforms: list[str] = lex.PLATFORMS, attributes: dict | None = None, constructs: dict | None = None, patterns: dict | None = None) -> Report:
    """Platform scores, the three tests, and the second for each choice of text columns, whose texts are scanned once each."""
    texts = {"keywords_and_abstract": ["keywords_raw", "index_keywords_raw", "abstract"], "author_keywords": ["keywords_raw"], "index_keywords": ["index_keywords_raw"]}
    docs = checkpointed(docs.select("year", "cited_by", *[c for c in dict.fromkeys(sum(texts.values(), [])) if c in docs.columns]))
    scores = {k: checkpointed(theory.platform_scores(theory.document_text(docs, columns), platforms, attributes, constructs, patterns)) for k, columns in texts.items()}
    whole = scores["keywords_and_abstract"]
    centrality = graphs.degrees(nodes, edges).select("node", F.col("node").alias("label"), "centrality")
    variants = None
    for name, own in scores.items():
        v = theory.score_vs_year(own).withColumn("text", F.lit(name))
        variants = v if variants is None else variants.unionByName(v)
    return {"scores": whole, "h1": theory.score_vs_centrality(whole, centrality), "h2": theory.score_vs_year(whole), "h3": theory.usefulness_vs_citations(whole), "h2_by_text": variants}


def lag_report(docs: DataFrame, min_docs: int = 3, families: dict = lex.TERM_FAMILIES) -> Report:
    """Term families in keywords and in abstracts, and their terms that are nodes of the keyword graph."""
    d = docs.withColumn("keywords", split_field(F.col("keywords_raw")))
    p = checkpointed(screening.family_presence(d, families))
    terms = F.explode(F.array(*[F.struct(F.lit(f).alias("family"), canonical_keyword(F.lit(t)).alias("node")) for f, ts in families.items() for t in ts]))
    listed = docs.sparkSession.range(1).select(terms.alias("x")).select("x.*").distinct()
    network = listed.join(co.nodes_of(keyword_items(docs), min_docs), "node").select("family", "node")
    return {"families": screening.family_lag(p), "by_year": screening.family_by_year(p), "network_terms": network}


def lotka_report(docs: DataFrame, k: int = 15) -> Report:
    a = src.authors(docs)
    dist = fr.productivity(a)
    return {"fit": laws.lotka(dist), "distribution": dist, "top_authors": fr.top_first_seen(a, k)}


def bradford_report(docs: DataFrame, n_zones: int = 3, per_zone: int = 25) -> Report:
    counts = fr.frequency(docs.select(F.trim("source").alias("item")))
    zones = checkpointed(laws.bradford_zones(counts, n_zones))
    s = laws.bradford_summary(zones)
    return {"zones": s, "multiplier": laws.bradford_multiplier(s), "sources": fr.top_per_group(zones, ["zone"], per_zone, F.col("i"))}


def thematic_report(nodes: DataFrame, edges: DataFrame, membership: DataFrame | None = None, seed: int = 42) -> Report:
    """The thematic map of a partition (node, cluster), by default Louvain's, with the 5 most frequent labels of each cluster."""
    if membership is None:
        membership = checkpointed(communities.communities(named(edges, "keywords"), "louvain", seed=seed).select("node", "cluster"))
    q = graphs.quadrants(graphs.callon(nodes, edges, membership))
    best = fr.top_per_group(nodes.join(membership, "node"), ["cluster"], 5, F.col("n").desc(), F.col("node"))
    return {"clusters": q, "labels": best}


def trend_report(docs: DataFrame, k: int = 25, window: int = 3) -> Report:
    m = checkpointed(trends.item_years(keyword_items(docs, canonical=False), k))
    return {"matrix": m, "emergence": trends.emergence(m, window).orderBy(F.col("emergence_index").desc(), "item")}


def three_field_report(docs: DataFrame, k_each: int = 10) -> Report:
    keywords = keyword_items(docs, canonical=False).select("doc_id", "item")
    sources = docs.where("source IS NOT NULL").select("doc_id", F.col("source").alias("item"))
    authors = src.authors(docs).select("doc_id", "item")
    return {"source_keyword": co.flows(sources, keywords, k_each), "author_keyword": co.flows(authors, keywords, k_each)}


def growth_report(docs: DataFrame, corpus: str = "corpus") -> Report:
    return {"models": laws.growth_models(fr.by_year(docs).withColumn("corpus", F.lit(corpus)))}


def capped_report(docs: DataFrame, cap: int, eras: list[tuple]) -> Report:
    """Growth and coupling again without the years after the cap."""
    d = screening.up_to_year(docs, cap)
    return growth_report(d) | {f"coupling_{k}": v for k, v in coupling_report(d, eras).items()}


def screening_report(docs: DataFrame) -> Report:
    s = screening.relevance(docs)
    return {"rates": screening.relevance_report(s), "flagged": screening.flagged_titles(s)}


def chat_report(messages: DataFrame, clusters: dict[int, list[str]], themes: dict[int, tuple[str, str]]) -> Report:
    """Transcripts' statistics, categories, themes, insights about clusters of keywords, and discussion points."""
    cats = checkpointed(chat.categories(messages))
    words = checkpointed(chat.theme_counts(messages))
    inter = chat.interpretations(chat.cluster_insights(messages, clusters), themes)
    return {
        "transcripts": chat.transcript_stats(messages),
        "summary": chat.summary(messages),
        "categories": chat.category_counts(cats),
        "themes": words,
        "clusters": inter,
        "points": chat.discussion_points(inter, cats, words),
    }


def full_analysis(docs: DataFrame) -> dict[str, Report | str]:
    """All reports of a corpus by name; one that fails is replaced by its error, and the others go on."""
    g = keyword_network(docs)
    todo: dict[str, Callable[[], Report]] = {
        "affiliation": lambda: affiliation_report(docs),
        "coupling": lambda: coupling_report(docs),
        "keyword_network": lambda: g,
        "normalisation": lambda: normalisation_report(docs),
        "sensitivity": lambda: sensitivity_report(g["edges"]),
        "theory": lambda: theory_report(docs, g["nodes"], g["edges"]),
        "lag": lambda: lag_report(docs),
        "lotka": lambda: lotka_report(docs),
        "bradford": lambda: bradford_report(docs),
        "thematic": lambda: thematic_report(g["nodes"], g["edges"]),
        "trends": lambda: trend_report(docs),
        "three_field": lambda: three_field_report(docs),
        "growth": lambda: growth_report(docs),
    }
    out: dict[str, Report | str] = {}
    for name, make in todo.items():
        try:
            out[name] = make()
        except Exception as e:  # noqa: BLE001 - a report's failure is part of the result
            out[name] = f"{type(e).__name__}: {e}"
    return out


def compare_corpora(corpora: dict[str, DataFrame]) -> dict[str, Report]:
    """The same measures for several corpora, side by side."""
    out = {}
    for name, docs in corpora.items():
        g = keyword_network(docs)
        d = fr.top(graphs.degrees(g["nodes"], g["edges"]), 10, F.col("centrality").desc(), F.col("node"))
        out[name] = {"density": graphs.density(g["nodes"], g["edges"]), "top_degree": d, **affiliation_report(docs), **growth_report(docs, name), **coupling_report(docs)}
    return out
