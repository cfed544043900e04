"""The registered queries of this subpackage: opN_<name> and pipeline, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from scimap.llm import bpe, centroids, chat, codes, line_dedup, lm, media, mixing, packing, quality, search, simhash, substring
from scimap.llm.common import table


def op1_bm25_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best documents of all for each document whose id is divisible by 20, by all terms of its whole text."""
    s = search.similar(table(spark, sf_dir, "documents"), every=20, k=10)
    return s.select(F.col("query").alias("query_id"), "rank", F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded by byte_bpe_50k and decoded again."""
    d = bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation in the view of each participant; spans as text start-end,start-end."""
    v = chat.rotate_perspectives(table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("spans", lambda x: F.concat(x["start"].cast("string"), F.lit("-"), x["end"].cast("string"))), ",")
    return v.withColumn("spans", spans)


def op4_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's probability by a bigram model learned from six sevenths of them."""
    return lm.score(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose key is in at least 10 documents are dropped from all documents."""
    d = line_dedup.dedup_lines(table(spark, sf_dir, "documents"), min_docs=10)
    return d.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of 3-word shingles, linked at 3 or fewer differing bits, and their components."""
    a = simhash.assign(table(spark, sf_dir, "documents"), words=3)
    return a.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to source weights 5, 2, 1, repeating."""
    m = mixing.mix(table(spark, sf_dir, "documents"))
    return m.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op8_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality by a quadratic discriminant learned from the labels that aren't held out."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as a grey image in tar shards and read back."""
    m = media.media_columns(table(spark, sf_dir, "documents"))
    m = m.withColumnRenamed("id", "doc_id").withColumn("feature", F.concat_ws(";", F.concat_ws("x", "width", "height"), "feature"))
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    return m.select(*names, "digest", "shard", "offset", "length")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of 13-word windows that also begin in an earlier document, removed from every document."""
    d = substring.remove_repeats(table(spark, sf_dir, "documents"))
    kept = F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")
    return d.select(F.col("id").alias("doc_id"), "n_words", "n_removed", kept)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's code of 16 parts by codebooks of 64 entries, and its error."""
    d, books = codes.compress(table(spark, sf_dir, "embeddings"))
    return d.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's cluster after three of Lloyd's rounds over 16 centroids."""
    d = centroids.cluster(table(spark, sf_dir, "embeddings"))
    text = F.array_join(F.col("centroid").cast("array<string>"), ",")
    return d.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", F.sha2(text, 256).alias("centroid_sha256"))


def op13_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' tokens in sequences of 1024 that share the corpus's mixture of sources."""
    p = packing.pack(table(spark, sf_dir, "documents"))
    return p.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline's token ids, as lowercase hex of little-endian 32-bit integers."""
    return corpus_pipeline.run(spark, sf_dir).withColumn("ids", F.lower(F.hex("ids")))


QUERIES = {
    "op1_bm25_top_k": op1_bm25_top_k,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_chat_perspectives": op3_chat_perspectives,
    "op4_deleted_interpolation": op4_deleted_interpolation,
    "op5_line_dedup": op5_line_dedup,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_source_mix": op7_source_mix,
    "op8_quality_qda": op8_quality_qda,
    "op9_media_columns": op9_media_columns,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_vector_codes": op11_vector_codes,
    "op12_centroid_clusters": op12_centroid_clusters,
    "op13_mixture_packing": op13_mixture_packing,
    "pipeline": pipeline,
}



def _codes_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """SQL for op 11: an entry's and a part's components are lists; each round is a table of nearest entries and one of means."""
    sql = f"""
        WITH v AS MATERIALIZED (
            SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        p AS MATERIALIZED (SELECT vec_id, part, v[part * len(v) // {parts} + 1 : (part + 1) * len(v) // {parts}] AS x FROM v, range({parts}) t(part)),
        first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v ORDER BY vec_id LIMIT {entries}),
        b0 AS MATERIALIZED (SELECT part, entry, x AS m FROM p JOIN first USING (vec_id))"""
    for i in range(rounds + 1):
        sql += f""",
        a{i} AS MATERIALIZED (
            SELECT vec_id, part, any_value(x) AS x, min(list_sum(list_transform(list_zip(x, m), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * {entries} + entry) AS best
            FROM p JOIN b{i} USING (part) GROUP BY vec_id, part)"""
        if i < rounds:
            sql += f""",
        c{i} AS MATERIALIZED (
            SELECT part, entry, list(m ORDER BY d) AS m FROM (
                SELECT part, best % {entries} AS entry, d, CAST(floor(sum(x[d]) / count(*)) AS BIGINT) AS m FROM a{i}, range(1, 1 + (SELECT max(len(x)) FROM p)) t(d) GROUP BY ALL)
            GROUP BY ALL),
        b{i + 1} AS MATERIALIZED (SELECT part, entry, coalesce(c.m, b.m) AS m FROM b{i} b LEFT JOIN c{i} c USING (part, entry))"""
    return sql + f""",
        e AS (
            SELECT vec_id, string_agg(printf('%02x', best % {entries}), '' ORDER BY part) AS code, CAST(sum(best // {entries}) AS BIGINT) AS error
            FROM a{rounds} GROUP BY vec_id)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
            (SELECT sha256(string_agg(array_to_string(m, ','), ',' ORDER BY part, entry)) FROM b{rounds}) AS codebooks_sha256
        FROM e JOIN v USING (vec_id)"""


def _clusters_sql(k: int = 16, rounds: int = 3) -> str:
    """SQL for op 12."""
    sql = f"""
        WITH v AS MATERIALIZED (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        b0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, v AS m FROM v ORDER BY sha256('1:' || vec_id) LIMIT {k})"""
    for i in range(rounds + 1):
        sql += f""",
        a{i} AS MATERIALIZED (
            SELECT vec_id, any_value(v) AS v, min(list_sum(list_transform(list_zip(v, m), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * {k} + c) AS best
            FROM v, b{i} GROUP BY vec_id)"""
        if i < rounds:
            sql += f""",
        c{i} AS MATERIALIZED (
            SELECT c, list(m ORDER BY d) AS m FROM (
                SELECT best % {k} AS c, d, CAST(floor(sum(v[d]) / count(*)) AS BIGINT) AS m FROM a{i}, range(1, 65) t(d) GROUP BY ALL)
            GROUP BY ALL),
        b{i + 1} AS MATERIALIZED (SELECT c, coalesce(n.m, b.m) AS m FROM b{i} b LEFT JOIN c{i} n USING (c))"""
    return sql + f"""
        SELECT vec_id, CAST(best % {k} AS INTEGER) AS cluster, CAST(best // {k} AS BIGINT) AS distance, CAST(sum(best // {k}) OVER (PARTITION BY best % {k}) AS BIGINT) AS cluster_inertia,
            CAST(sum(best // {k}) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
        FROM a{rounds} JOIN b{rounds} ON c = best % {k}"""


ORACLES = {
    "op11_vector_codes": _codes_sql(),
    "op12_centroid_clusters": _clusters_sql(),
    "op3_chat_perspectives": r"""
        WITH m AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
        -- marks in names and texts are escaped
        people AS (SELECT DISTINCT conv_id AS c, role AS perspective FROM m WHERE role <> 'system'),
        r AS (
            SELECT conv_id, perspective, turn, role, text, CAST(floor(turn / 64.0) AS BIGINT) AS segment,
                CASE WHEN role = 'system' THEN '<|system|>' WHEN role = perspective THEN '<|assistant|>' ELSE '<|user:' || regexp_replace(role, '<(\\*)\|', '<\1\\|', 'g') || '|>' END || chr(10) AS head,
                regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g') || '<|end|>' AS body
            FROM m JOIN people ON conv_id IS NOT DISTINCT FROM c),
        p AS (SELECT *, CAST((row_number() OVER (PARTITION BY conv_id, perspective, segment ORDER BY turn NULLS FIRST, role, text) - 1) // 1024 AS BIGINT) AS part FROM r),
        s AS (
            SELECT *, sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, perspective, segment, part ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) - length(body) - 1 AS start
            FROM p)
        SELECT conv_id, perspective, segment, part, count(*) AS n_messages,
            string_agg(head || body || chr(10), '' ORDER BY turn, role, text) AS dialogue,
            coalesce(string_agg(CAST(start AS VARCHAR) || '-' || CAST(start + length(body) AS VARCHAR), ',' ORDER BY turn, role, text) FILTER (role = perspective), '') AS spans,
            CAST(coalesce(sum(length(body)) FILTER (role = perspective), 0) AS BIGINT) AS n_learned
        FROM s GROUP BY conv_id, perspective, segment, part""",
    "op5_line_dedup": """
        WITH l AS (
            SELECT doc_id, i, lines[i] AS line,
                translate(trim(lines[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents)),
        often AS (SELECT key FROM l WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
        SELECT doc_id, count(*) AS n_lines, count(often.key) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (often.key IS NULL), '')) AS kept_sha256
        FROM l LEFT JOIN often USING (key) GROUP BY doc_id""",
}
