"""Queries: strings, screening, platforms, transcripts."""

from __future__ import annotations

from pyspark.sql import functions as F

from scimap.functions import lexicons as lex
from scimap.functions import text as tx
from scimap.operators import chat, screening, theory
from scimap.operators.agreement import spearman
from scimap.plans import adapter as ad
from scimap.plans.adapter import with_
from scimap.plans.base import query
from scimap.sources.tables import table


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def values(rows) -> str:
    return ", ".join("(" + ", ".join(quoted(x) for x in r) + ")" for r in rows)


SINGULAR = """CASE WHEN {w} LIKE '%ies' AND length({w}) > 4 THEN left({w}, length({w}) - 3) || 'y'
    WHEN regexp_matches({w}, '(s|x|z|ch|sh)es$') THEN left({w}, length({w}) - 2)
    WHEN {w} LIKE '%s' AND {w} NOT LIKE '%ss' AND length({w}) > 3 THEN left({w}, length({w}) - 1) ELSE {w} END"""

RAW_KEYWORD = "'  ' || upper(p_name) || CASE p_partkey % 5 WHEN 0 THEN 's' WHEN 1 THEN ' Analytics' WHEN 2 THEN '  Studies. ' WHEN 3 THEN ' boxes' ELSE '' END"
SPECIAL = "CASE p_partkey % 11 WHEN 0 THEN ' Serious  Games' WHEN 1 THEN '\"GenAI\".' WHEN 2 THEN 'Unity3D' ELSE raw END"


@query(f"""WITH syn AS (SELECT * FROM (VALUES {values(lex.SYNONYMS.items())}) t(k, v)),
    a AS (SELECT p_partkey, {SPECIAL} AS raw FROM (SELECT p_partkey, {RAW_KEYWORD} AS raw FROM part)),
    b AS (SELECT *, trim(regexp_replace(lower(trim(raw)), '\\s+', ' ', 'g'), {quoted(lex.KEYWORD_STRIP)}) AS s FROM a),
    c AS (SELECT *, regexp_extract(s, '([^ ]*)$', 1) AS w FROM b),
    d AS (SELECT *, left(s, length(s) - length(w)) || CASE WHEN w IN ({", ".join(map(quoted, lex.PROTECTED))}) THEN w ELSE {SINGULAR.format(w="w")} END AS h FROM c)
    SELECT p_partkey, coalesce(x.v, y.v, h) AS keyword FROM d LEFT JOIN syn x ON x.k = s LEFT JOIN syn y ON y.k = h""")
def str_canonical_keyword(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.expr(RAW_KEYWORD).alias("raw")).select("p_partkey", F.expr(SPECIAL).alias("raw"))
    return p.select("p_partkey", tx.canonical_keyword(F.col("raw")).alias("keyword"))


@query(f"""WITH w AS (SELECT DISTINCT unnest(string_split(lower(text), ' ')) AS word FROM documents)
    SELECT word, {SINGULAR.format(w="word")} AS singular FROM w WHERE regexp_matches(word, '^[a-z]+$')""")
def str_singular(spark, sf):
    d = table(spark, sf, "documents")
    w = d.select(F.explode(F.split(F.lower("text"), " ")).alias("word")).where(F.col("word").rlike("^[a-z]+$")).distinct()
    return w.select("word", tx.singular(F.col("word")).alias("singular"))


RAW_COUNTRY = "CASE n_nationkey % 6 WHEN 0 THEN ' U.S.A. ' WHEN 1 THEN 'Viet Nam.' WHEN 2 THEN 'UK' WHEN 3 THEN 'Russia..' WHEN 4 THEN 'korea' ELSE n_name END"


@query(f"""WITH al AS (SELECT * FROM (VALUES {values(lex.COUNTRY_ALIASES.items())}) t(k, v)),
    a AS (SELECT n_nationkey, trim(rtrim(trim({RAW_COUNTRY}), '.')) AS s FROM nation)
    SELECT n_nationkey, coalesce(v, s) AS country FROM a LEFT JOIN al ON k = replace(lower(s), '.', '')""")
def str_country_norm(spark, sf):
    n = table(spark, sf, "nation").select("n_nationkey", F.expr(RAW_COUNTRY).alias("raw"))
    return n.select("n_nationkey", tx.normalise_country(F.col("raw")).alias("country"))


RAW_REFERENCE = """CASE l_partkey % 5 WHEN 0 THEN 'Smith J., A title (' || cast(1990 + l_suppkey % 30 as {text}) || ') Journal'
    WHEN 1 THEN 'Doe A., Other, https://doi.org/10.' || cast(1000 + l_suppkey as {text}) || '/ABC.' || cast(l_partkey as {text}) || '., 5'
    WHEN 2 THEN '12, Number only (2001)' WHEN 3 THEN 'van Eck N., Waltman L. no year' ELSE 'De Luca ' || cast(l_suppkey as {text}) || ', Book (2016), (2018)' END"""


@query(f"""WITH r AS (SELECT DISTINCT {RAW_REFERENCE.format(text="VARCHAR")} AS ref FROM lineitem),
    p AS (SELECT ref, rtrim(lower(regexp_extract(ref, {quoted(lex.DOI_PATTERN)})), '.,') AS doi, regexp_extract(ref, {quoted(lex.YEAR_PATTERN)}, 1) AS y, lower(trim(string_split(ref, ',')[1])) AS name FROM r)
    SELECT ref, CASE WHEN doi <> '' THEN doi WHEN y <> '' AND length(name) >= 3 AND NOT regexp_matches(name, '^[0-9]+$') THEN string_split(name, ' ')[1] || '_' || y END AS key FROM p""")
def str_reference_key(spark, sf):
    r = table(spark, sf, "lineitem").select(F.expr(RAW_REFERENCE.format(text="string")).alias("ref")).distinct()
    return r.select("ref", tx.reference_key(F.col("ref")).alias("key"))


@query("""WITH raw AS (SELECT l_orderkey AS doc_id, s_name, n_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2, 3)
    SELECT doc_id, s_name || ', A.' AS author, 'Institute ' || n_name AS institution, n_name AS country FROM raw WHERE doc_id % 7 <> 3""")
def str_affiliation_triples(spark, sf):
    """Affiliation strings are built from an order's suppliers, entries too short to parse where the id leaves 3 modulo 7, and parsed."""
    li, s, n = (table(spark, sf, t) for t in ("lineitem", "supplier", "nation"))
    rows = li.join(s, li["l_suppkey"] == s["s_suppkey"]).join(n, s["s_nationkey"] == n["n_nationkey"]).select(F.col("l_orderkey").alias("doc_id"), "s_name", "n_name").distinct()
    entry = F.when(F.col("doc_id") % 7 == 3, F.concat_ws(", ", "s_name", "n_name")).otherwise(F.concat(F.col("s_name"), F.lit(", A., Institute "), F.col("n_name"), F.lit(", City , "), F.col("n_name"), F.lit(". ")))
    raw = rows.groupBy("doc_id").agg(F.array_join(F.collect_list(entry), "; ").alias("raw"))
    return raw.select("doc_id", F.inline(tx.affiliations(F.col("raw"))))


@query("""SELECT part_name, count(*) AS n FROM (SELECT trim(unnest(string_split(p_name || ' ; ' || p_type || ';;' || p_brand, ';'))) AS part_name FROM part) WHERE part_name <> '' GROUP BY 1""")
def str_field_split(spark, sf):
    raw = F.concat(F.col("p_name"), F.lit(" ; "), F.col("p_type"), F.lit(";;"), F.col("p_brand"))
    return table(spark, sf, "part").select(F.explode(tx.split_field(raw)).alias("part_name")).groupBy("part_name").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH raw AS (SELECT s_suppkey, 'Dept, ' || n_name || '; No comma; Inst, UK; A , ' || r_name AS a FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
    p AS (SELECT s_suppkey, trim(unnest(string_split(a, ';'))) AS x FROM raw), c AS (SELECT s_suppkey, trim(string_split(x, ',')[-1]) AS country FROM p WHERE contains(x, ','))
    SELECT country, count(DISTINCT s_suppkey) AS n FROM c WHERE length(country) > 2 GROUP BY 1""")
def str_simple_countries(spark, sf):
    s, n, r = (table(spark, sf, t) for t in ("supplier", "nation", "region"))
    j = s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    raw = F.concat(F.lit("Dept, "), F.col("n_name"), F.lit("; No comma; Inst, UK; A , "), F.col("r_name"))
    c = j.select("s_suppkey", F.explode(tx.simple_countries(raw)).alias("country")).distinct()
    return c.groupBy("country").agg(F.count(F.lit(1)).alias("n"))


ERAS = [("early", None, 1996), ("middle", 1997, 1999), ("late", 1999, None)]


@query(f"""{with_("docs")}, eras AS (SELECT * FROM (VALUES ('early', 0, 1996), ('middle', 1997, 1999), ('late', 1999, 9999)) t(era, a, b))
    SELECT era, count(*) AS n FROM docs JOIN eras ON year BETWEEN a AND b GROUP BY 1""")
def flt_eras(spark, sf):
    return screening.in_eras(ad.years(spark, sf), ERAS).groupBy("era").agg(F.count(F.lit(1)).alias("n"))


@query(f"{with_('docs')} SELECT year, count(*) AS n FROM docs WHERE year <= 1999 GROUP BY 1")
def flt_year_cap(spark, sf):
    return screening.up_to_year(ad.years(spark, sf), 1999).groupBy("year").agg(F.count(F.lit(1)).alias("n"))


ONE, TWO = ["ing", "ment", "heit"], ["src1", "tion of", "worthless", "k-12"]


def _screen_sql(terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains(t, {quoted(x)})" for x in terms) + ")"


@query(f"""WITH d AS (SELECT lower(source || ' ' || text) AS t FROM documents), r AS (SELECT {_screen_sql(ONE)} AND {_screen_sql(TWO)} AS kept FROM d)
    SELECT count(*) AS total, count(*) FILTER (kept) AS n_retained, count(*) FILTER (NOT kept) AS n_flagged, round(count(*) FILTER (kept) / count(*), 4) AS retained_rate, round(count(*) FILTER (NOT kept) / count(*), 4) AS flagged_rate FROM r""")
def flt_relevance_screen(spark, sf):
    return screening.relevance_report(screening.relevance(_abstracts(spark, sf), ONE, TWO))


@query(f"""WITH d AS (SELECT doc_id, source, lower(source || ' ' || text) AS t FROM documents) SELECT doc_id, source AS title FROM d WHERE NOT ({_screen_sql(ONE)} AND {_screen_sql(TWO)}) AND source <> '' ORDER BY 1 LIMIT 15""")
def flt_flagged_titles(spark, sf):
    return screening.flagged_titles(screening.relevance(_abstracts(spark, sf), ONE, TWO))


def _abstracts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.col("source").alias("title"), F.col("text").alias("abstract"))


FAMILIES = {"common": ["the", "of the"], "endings": ["tion", "games"], "german": ["heit", "keit"], "rare": ["worthless", "idiot"]}


def _family_docs(spark, sf):
    """Documents with two keywords of their language and source, a year by id, and the text as abstract."""
    kw = F.array(F.concat(F.lit("Source "), F.col("source")), F.when(F.col("doc_id") % 5 == 0, "The").when(F.col("doc_id") % 5 == 1, "Game").otherwise(F.col("lang")))
    return table(spark, sf, "documents").select("doc_id", (2018 + F.col("doc_id") % 8).cast("int").alias("year"), kw.alias("keywords"), F.col("text").alias("abstract"))


FAMILY = f"""WITH d AS (SELECT doc_id, CAST(2018 + doc_id % 8 AS INTEGER) AS year, CASE doc_id % 5 WHEN 0 THEN 'the' WHEN 1 THEN 'game' ELSE lang END AS k, lower(text) AS t FROM documents),
    p AS (SELECT doc_id, year, f.family, list_contains(f.canon, k) AS in_keywords, len(list_filter(f.terms, lambda x: contains(t, x))) > 0 AS in_abstract
        FROM d CROSS JOIN (SELECT * FROM (VALUES {", ".join(f"({quoted(n)}, {t!r}, {['game' if x == 'games' else x for x in t]!r})" for n, t in FAMILIES.items())}) v(family, terms, canon)) f)"""


@query(f"{FAMILY} SELECT family, count(*) FILTER (in_keywords) AS n_keyword_docs, count(*) FILTER (in_abstract) AS n_abstract_docs, count(*) FILTER (in_abstract AND year >= 2022) AS n_recent_abstract_docs FROM p GROUP BY 1")
def agg_lag_counts(spark, sf):
    return screening.family_lag(screening.family_presence(_family_docs(spark, sf), FAMILIES))


@query(f"{FAMILY} SELECT family, year, count(*) AS n FROM p WHERE in_abstract GROUP BY 1, 2")
def flt_term_family(spark, sf):
    return screening.family_by_year(screening.family_presence(_family_docs(spark, sf), FAMILIES))


PLATFORMS = ["the", "of the", "heit", "construct", "and", "ing"]
#: Words between other characters than a-z, 0-9 and _: what \b takes for a letter beyond ASCII differs between engines.
PATTERNS = {p: r"(?:^|[^a-z0-9_])(?:" + words + r")(?:$|[^a-z0-9_])" for p, words in {"the": "the", "heit": "heit", "and": "and", "ing": "ing", "construct": "worthless|idiot"}.items()}
ATTRIBUTES = {"first": ["tion", "ing", "of", "keit"], "second": ["ment", "the", "worthless"]}
CONSTRUCTS = {"perceived_usefulness": ["er", "on", "que", "sch", "de la"]}


def _platform_texts(spark, sf):
    d = table(spark, sf, "documents")
    d = d.select("doc_id", (2000 + F.col("doc_id") % 20).alias("year"), (F.col("n_chars") % 50).alias("cited_by"), "source", F.col("text").alias("abstract"))
    return theory.document_text(d, ["source", "missing", "abstract"])


def _mentions() -> str:
    return " UNION ALL ".join(f"SELECT {quoted(p)} AS platform, * FROM d WHERE regexp_matches(t, {quoted(tx.platform_pattern(p, PATTERNS))})" for p in PLATFORMS)


def _share(terms: list[str]) -> str:
    return "(" + " + ".join(f"CAST(contains(t, {quoted(x)}) AS INTEGER)" for x in terms) + f") / {len(terms)}"


PLATFORM = f"""WITH d AS (SELECT doc_id, 2000 + doc_id % 20 AS year, n_chars % 50 AS cited_by, lower(source || ' ' || text) AS t FROM documents),
    m AS ({_mentions()}),
    s AS (SELECT platform, count(*) AS n_docs, avg({_share(ATTRIBUTES["first"])}) AS a1, avg({_share(ATTRIBUTES["second"])}) AS a2, avg({_share(CONSTRUCTS["perceived_usefulness"])}) AS perceived_usefulness, avg(year) AS mean_year, avg(cited_by) AS mean_citations FROM m GROUP BY 1)"""


@query(f"{PLATFORM} SELECT platform, count(*) AS n FROM m GROUP BY 1")
def flt_platform_mention(spark, sf):
    return screening.platform_mentions(_platform_texts(spark, sf), PLATFORMS, PATTERNS).groupBy("platform").agg(F.count(F.lit(1)).alias("n"))


@query(f"{PLATFORM} SELECT platform, n_docs, round(a1, 6) AS first, round(a2, 6) AS second, round(a1 + a2, 6) AS total, round(perceived_usefulness, 6) AS perceived_usefulness, round(mean_year, 6) AS mean_year, round(mean_citations, 6) AS mean_citations FROM s")
def agg_attribute_score(spark, sf):
    s = theory.platform_scores(_platform_texts(spark, sf), PLATFORMS, ATTRIBUTES, CONSTRUCTS, PATTERNS)
    return s.select("platform", "n_docs", *[F.round(c, 6).alias(c) for c in ("first", "second", "total", "perceived_usefulness", "mean_year", "mean_citations")])


def _rho(x: str, y: str) -> str:
    return f"""r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry FROM (SELECT {x} AS x, {y} AS y FROM s))
    SELECT round(corr(rx, ry), 6) AS rho, count(*) AS n FROM r"""


@query(f"{PLATFORM}, {_rho('a1 + a2', 'mean_year')}")
def stat_score_vs_year(spark, sf):
    s = theory.platform_scores(_platform_texts(spark, sf), PLATFORMS, ATTRIBUTES, CONSTRUCTS, PATTERNS)
    return theory.score_vs_year(s).select(F.round("rho", 6).alias("rho"), "n")


@query(f"{PLATFORM}, {_rho('perceived_usefulness', 'mean_citations')}")
def stat_usefulness_vs_citations(spark, sf):
    s = theory.platform_scores(_platform_texts(spark, sf), PLATFORMS, ATTRIBUTES, CONSTRUCTS, PATTERNS)
    return theory.usefulness_vs_citations(s).select(F.round("rho", 6).alias("rho"), "n")


@query("""WITH v AS (SELECT lang AS variant, doc_id % 97 AS x, n_chars % 89 AS y FROM documents),
    r AS (SELECT variant, rank() OVER (PARTITION BY variant ORDER BY x) + (count(*) OVER (PARTITION BY variant, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY variant ORDER BY y) + (count(*) OVER (PARTITION BY variant, y) - 1) / 2 AS ry FROM v)
    SELECT variant, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM r GROUP BY 1""")
def stat_spearman_variants(spark, sf):
    """One correlation for each variant of the text source, in one grouped plan."""
    d = table(spark, sf, "documents").select(F.col("lang").alias("variant"), (F.col("doc_id") % 97).alias("x"), (F.col("n_chars") % 89).alias("y"))
    return spearman(d, ["variant"]).withColumn("rho", F.round("rho", 6))


THEMES = ["the", "of", "tion", "heit", "missing word", "que", "the"]


@query(f"""WITH w AS (SELECT DISTINCT unnest({THEMES!r}) AS word) SELECT word, count(*) AS n FROM w JOIN conversations ON contains(lower(text), word) GROUP BY 1""")
def agg_theme_counts(spark, sf):
    return chat.theme_counts(ad.messages(spark, sf), THEMES)


@query(f"""{with_("messages")} SELECT date, count(*) AS n, count(*) FILTER (is_advisor) AS n_advisor, count(*) FILTER (NOT is_advisor) AS n_student,
    round(((arg_max(secs % 86400, seq)) - (arg_min(secs % 86400, seq))) / 60, 6) AS minutes FROM messages GROUP BY 1""")
def agg_transcript_stats(spark, sf):
    return chat.transcript_stats(ad.messages(spark, sf)).withColumn("minutes", F.round("minutes", 6))


@query(f"{with_('messages')} SELECT count(*) AS n_messages, count(DISTINCT date) AS n_transcripts, count(*) FILTER (is_advisor) AS n_advisor, round(count(*) FILTER (is_advisor) / count(*), 6) AS advisor_ratio FROM messages")
def agg_chat_summary(spark, sf):
    return chat.summary(ad.messages(spark, sf)).withColumn("advisor_ratio", F.round("advisor_ratio", 6))


CATEGORIES = [("worthless|keiten der", "rare"), ("heit|ción", "endings"), ("the|le ", "articles"), ("a", "letter")]


def _case() -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower(content), {quoted(p)}) THEN {quoted(n)}" for p, n in CATEGORIES) + " END"


@query(f"{with_('messages')} SELECT * FROM (SELECT date, seq, {_case()} AS category, left(content, 300) AS excerpt FROM messages WHERE is_advisor) WHERE category IS NOT NULL")
def chat_categories(spark, sf):
    return chat.categories(ad.messages(spark, sf), CATEGORIES)


@query(f"{with_('messages')} SELECT category, count(*) AS n FROM (SELECT {_case()} AS category FROM messages WHERE is_advisor) WHERE category IS NOT NULL GROUP BY 1")
def chat_category_counts(spark, sf):
    return chat.category_counts(chat.categories(ad.messages(spark, sf), CATEGORIES))


CLUSTERS = {1: ["the", "heit"], 2: ["ción", "worthless"], 3: ["of the"]}


@query(f"""{with_("messages")}, m AS ({" UNION ALL ".join(f"SELECT CAST({c} AS INTEGER) AS cluster, * FROM messages WHERE is_advisor AND regexp_matches(lower(content), {quoted(screening.any_term(w))})" for c, w in CLUSTERS.items())}),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY cluster ORDER BY date, seq) AS INTEGER) AS rank FROM m)
    SELECT cluster, rank, '[' || date || '] ' || CASE WHEN length(content) > 200 THEN left(content, 200) || '...' ELSE content END AS insight FROM r WHERE rank <= 5""")
def chat_cluster_insights(spark, sf):
    return chat.cluster_insights(ad.messages(spark, sf), CLUSTERS)


@query("""SELECT conv_id, turn, CASE WHEN length(text) > 40 THEN left(text, 40) || '...' ELSE text END AS short FROM conversations""")
def str_truncation(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", tx.shortened(F.col("text"), 40).alias("short"))


@query(f"""WITH d AS (SELECT doc_id, lower(source || ' ' || text) AS t FROM documents), r AS (SELECT doc_id FROM d WHERE {_screen_sql(ONE)} AND {_screen_sql(TWO)})
    SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM r""")
def set_complement(spark, sf):
    s = screening.relevance(_abstracts(spark, sf), ONE, TWO)
    return s.select("doc_id").exceptAll(s.where("retained").select("doc_id"))


@query("""SELECT DISTINCT p_name AS term FROM part WHERE p_size < 10 INTERSECT SELECT DISTINCT p_name FROM part WHERE p_size > 40""")
def set_intersection(spark, sf):
    p = table(spark, sf, "part")
    return p.where("p_size < 10").select(F.col("p_name").alias("term")).intersect(p.where("p_size > 40").select("p_name"))


@query("""SELECT p_brand AS key FROM part WHERE p_size < 5 UNION SELECT p_type FROM part WHERE p_size > 45""")
def set_union(spark, sf):
    p = table(spark, sf, "part")
    return p.where("p_size < 5").select(F.col("p_brand").alias("key")).union(p.where("p_size > 45").select("p_type")).distinct()


@query("""SELECT DISTINCT l_orderkey, l_partkey FROM lineitem""")
def set_distinct_per_document(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey").distinct()
