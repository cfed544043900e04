"""Nulls in any column, empty and very long texts, repeated rows, empty tables and clashing column names, for every operator."""

import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scimap.llm import bpe, chat, line_dedup, lm, media, mixing, quality, search, simhash, substring

LONG = "word " * 30_000 + "x" * 50_000
ROWS = [
    (0, "Alpha beta.\n\nshared line\nAlpha", "en", "s1", 10),
    (1, None, None, None, None),
    (2, "", "en", "s1", 0),
    (3, " \t\x0b\n ", "en", None, 5),
    (4, LONG, "en", "s2", len(LONG)),
    (4, LONG, "en", "s2", len(LONG)),
    (5, "same text for two ids, long enough to be a window of thirteen words of it all", "fr", "s3", 1),
    (6, "same text for two ids, long enough to be a window of thirteen words of it all", "fr", "s3", 1),
    (None, "no id but text", "de", "s2", 3),
    (None, None, None, None, None),
    (7, "ünïcödé ÄÖ   nbsp 漢字\r\n", "de", "", 7),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that operators use for columns of their own.
CLASHES = [
    *("ids", "n_tokens", "decoded", "x", "score", "kept_text", "n_lines", "n_dropped", "words", "lines", "text_hash", "times", "fp", "size", "id"),
    *("_id", "_th", "_source", "_text_hash", "own_id", "own_hash", "own_source", "a.b", "bits", "TEXT_HASH_", "label", "shard"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def wide(docs):
    return docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHES)])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(8)] + [(None, 1, 0), (3, None, None)], "doc_id bigint, quality int, toxic int")


def empty(df):
    return df.where("false")


def test_bpe(docs, wide):
    rows = bpe.decode(bpe.encode(docs)).collect()
    assert len(rows) == len(ROWS)
    assert all(r.decoded == (r.text or "").encode() and len(r.ids) == 4 * r.n_tokens for r in rows)
    out = bpe.decode(bpe.encode(wide), "ids_")
    assert set(wide.columns) < set(out.columns) and {"n_tokens_", "ids_", "decoded_"} <= set(out.columns)
    assert all(bytes(r.decoded_) == (r.text or "").encode() for r in out.collect())
    assert bpe.encode(empty(docs)).count() == 0


def test_lines(docs, wide):
    rows = line_dedup.dedup_lines(docs, min_docs=2).collect()
    assert len(rows) == len(ROWS)
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert (by[1].n_lines, by[2].n_lines, by[2].kept_text, by[3].n_dropped) == (1, 1, "", 0)
    assert (by[5].n_dropped, by[5].kept_text, by[6].n_dropped) == (1, "", 1)
    assert by[4].n_dropped == 0  # two rows of one document
    first = {r.doc_id: r.n_dropped for r in line_dedup.dedup_lines(docs, min_docs=2, keep_first=True).collect()}
    assert (first[5], first[6]) == (0, 1)
    out = line_dedup.dedup_lines(wide, min_docs=2)
    assert out.columns[: len(wide.columns)] == wide.columns and out.count() == len(ROWS)
    assert line_dedup.dedup_lines(empty(docs)).count() == 0


def test_a_document_of_many_lines(spark):
    """The work of a document grows with its length: a text is hashed and split once, not once a line."""
    lines = [f"line {i % 300_000}" if i % 3 else "" for i in range(1_000_000)]
    rows = [(1, "\n".join(lines)), (2, "line 1\nline 4\nmine"), (3, "line 1")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    begin = time.monotonic()
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs, min_docs=2).collect()}
    assert time.monotonic() - begin < 60
    gone = {"line 1", "line 4"}
    kept = [x for x in lines if x not in gone]
    assert got[1].n_lines == 1_000_000 and got[1].n_dropped == 1_000_000 - len(kept) > 2 and got[1].kept_text == "\n".join(kept)
    assert (got[2].kept_text, got[2].n_dropped, got[3].kept_text, got[3].n_dropped) == ("mine", 2, "", 1)


@pytest.fixture(scope="module")
def dotted(docs):
    return docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHES) if c not in ("a.b", "id", "ids", "shard", "label")]).withColumnsRenamed({"doc_id": "an.id", "text": "a.text", "source": "a.source"})


def test_columns_with_dots(dotted, docs):
    """Names with dots, and columns that clash with operators' own: the same results as under plain names."""
    pairs = [
        (media.media_columns(dotted, "an.id", "a.text").select("id", "n_bytes", "payload_sha256"), media.media_columns(docs).select("id", "n_bytes", "payload_sha256")),
        (substring.remove_repeats(dotted, "an.id", "a.text").select("id", "n_words", "n_removed"), substring.remove_repeats(docs).select("id", "n_words", "n_removed")),
        (lm.score(dotted, "an.id", "a.text").select("id", "n_tokens", "base_score"), lm.score(docs).select("id", "n_tokens", "base_score")),
        (simhash.assign(dotted, "an.id", "a.text").select("id", "component_id"), simhash.assign(docs).select("id", "component_id")),
        (mixing.mix(dotted, "an.id", "a.text", "a.source").select("id", "taken"), mixing.mix(docs).select("id", "taken")),
        (search.similar(dotted, "an.id", "a.text", every=1, k=3), search.similar(docs, every=1, k=3)),
        (line_dedup.dedup_lines(dotted, "an.id", "a.text", 2).select("`an.id`", "n_dropped_"), line_dedup.dedup_lines(docs, min_docs=2).select("doc_id", "n_dropped")),
        (bpe.encode(dotted, "a.text").select("`an.id`", "n_tokens_"), bpe.encode(docs).select("doc_id", "n_tokens")),
    ]
    for a, b in pairs:
        assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)


def test_simhash(docs, wide):
    rows = simhash.assign(docs).collect()
    assert len(rows) == len(ROWS)
    by = {r.id: r for r in rows if r.id is not None}
    assert by[1].fp == by[2].fp == by[3].fp == 0 and by[2].component_id == by[3].component_id == 1
    assert by[6].component_id == 5
    kept = simhash.dedup(wide)
    assert kept.columns == wide.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [0, 1, 4, 5, 7] and ids.count(None) == 1
    assert simhash.assign(empty(docs)).count() == 0 and simhash.dedup(empty(docs)).count() == 0


def test_mixing(docs, wide):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.taken <= 3 * r.size for r in rows)
    assert rows and sorted(rows, key=str) == sorted(mixing.mix(docs).collect(), key=str)
    total = sum(r.size for r in rows)
    assert sum({r.source: r.target for r in rows}.values()) == pytest.approx(total)
    assert mixing.apply_mix(wide).columns == wide.columns
    assert mixing.mix(empty(docs)).count() == 0
    blank = docs.withColumn("text", F.lit(None).cast("string"))
    assert all((r.size, r.target, r.taken) == (0, 0, 0) for r in mixing.mix(blank).collect())


def test_quality(docs, wide, labels):
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
    assert all(r.held_out for r in rows if r.doc_id is None)
    assert quality.keep_good(wide, labels).columns == wide.columns
    assert {r.score for r in quality.classify(docs, empty(labels)).collect()} == {0.5}
    assert {r.score for r in quality.classify(docs, labels.where("quality = 1")).collect()} == {1.0}
    assert quality.classify(empty(docs), labels).count() == 0


def test_media(docs):
    rows = media.media_columns(docs).collect()
    assert len(rows) == len(ROWS)
    blank = [r for r in rows if r.n_bytes == 0]
    assert len(blank) == 3 and {(r.payload_bytes, r.height) for r in blank} == {(64, 1)}
    assert len({(r.digest, r.shard, r.offset) for r in rows}) == len({r.digest for r in rows})
    assert media.media_columns(empty(docs)).count() == 0


def test_substring(docs):
    rows = substring.remove_repeats(docs).collect()
    assert len(rows) == len(ROWS)
    by = {r.id: r for r in rows if r.id is not None}
    assert (by[5].n_removed, by[6].n_removed, by[6].kept_text, by[6].spans) == (0, 17, "", [0, 17])
    assert by[1].n_words == by[3].n_words == 0 and by[4].n_removed == 0
    assert substring.remove_repeats(empty(docs)).count() == 0


def test_lm(docs):
    rows = lm.score(docs).collect()
    assert len(rows) == len(ROWS)
    assert all(r.held_out for r in rows if r.id is None)
    by = {r.id: r for r in rows if r.id is not None}
    assert by[1].n_tokens == by[2].n_tokens == by[3].n_tokens == 1
    assert all(r.score <= 0 and r.base_score <= 0 for r in rows)
    assert lm.score(empty(docs)).count() == 0
    unlearned = lm.score(docs.where("doc_id IS NULL")).collect()
    assert {(r.train_tokens, r.n_known, r.score, r.base_score) for r in unlearned} == {(0, 0, 0.0, 0.0)}


def test_search(docs, spark):
    rows = search.similar(docs, every=1, k=3).collect()
    assert {(r["query"], r.doc) for r in rows if r["query"] in (5, 6)} == {(a, b) for a in (5, 6) for b in (5, 6)}
    assert [r.doc for r in rows if r["query"] == 4] == [4, 4]
    assert search.similar(empty(docs)).count() == 0
    queries = spark.createDataFrame([(1, "TWO ids"), (2, None), (3, "unheard")], "item_id bigint, text string")
    found = [(r["query"], r["rank"], r.doc) for r in search.search(docs, queries).collect()]
    assert sorted(found) == [(1, 1, 5), (1, 2, 6)]
    assert search.search(docs, empty(queries)).count() == 0


def test_chat(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "a"), (1, 2, "assistant", None), (1, 2, "assistant", None), (None, None, None, "x"), (2, 0, "system", "only"), (3, 70, "user", "b")]
    m = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("dialogue", F.lit(1))
    got = {(r.conv_id, r.perspective, r.segment): r for r in chat.rotate_perspectives(m).collect()}
    assert set(got) == {(1, "user", 0), (1, "assistant", 0), (None, "unknown", None), (3, "user", 1)}
    view = got[1, "assistant", 0]
    assert view.dialogue == "<|system|>\ns<|end|>\n<|user:user|>\na<|end|>\n" + "<|assistant|>\n<|end|>\n" * 2
    assert [view.dialogue[s.start : s.end] for s in view.spans] == ["<|end|>"] * 2 and view.n_learned == 14
    assert [got[1, "user", 0].dialogue[s.start : s.end] for s in got[1, "user", 0].spans] == ["a<|end|>"]
    assert chat.rotate_perspectives(empty(m)).count() == 0


def test_pipeline_stages(spark, wide, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for table in (wide, empty(wide)):
        docs = table
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, str(tmp_path))
            path = f"{tmp_path}/{i}-{table is wide}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if i < 4:
                assert docs.columns == wide.columns
        if table is not wide:
            assert docs.count() == 0
