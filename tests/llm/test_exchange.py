"""Many chunks, buckets, nodes, passes and blocks: results are those of one of each."""

import numpy as np
import pytest
import xxhash

from scimap.llm import chunks, lm, search, simhash, substring
from scimap.llm.common import table

SF = "/root/testdata/sf0.001"
ROUTES = [{"chunk_bytes": 32 << 10, "bucket_bytes": 32 << 10}, {"chunk_bytes": 32 << 10, "bucket_bytes": 16 << 10, "fan": 4}]


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


def rounded(df):
    return sorted(tuple(round(x, 6) if isinstance(x, float) else str(x) for x in r) for r in df.collect())


def test_messages_grow_less_than_the_square():
    for n in (10, 4096, 10**4, 10**6, 10**7):
        ranges, each, groups = chunks.route(n, n)
        assert ranges * each >= n and (ranges, each, groups) == ((n, 1, 0) if n <= chunks.FAN else (ranges, each, groups))
        messages = n * ranges + groups * ranges * each
        assert messages <= n * chunks.FAN if n <= chunks.FAN else messages <= 2.1 * (n + n**0.5 + 1) * (n**0.5 + 2)


@pytest.mark.parametrize("sizes", ROUTES)
def test_chunks_and_buckets(spark, docs, sizes):
    c = chunks.chunked(docs, "doc_id", "text", **sizes)
    assert c.n_chunks > 5 and c.buckets > 5 and c.n_docs == docs.count()
    assert (c.ranges < c.buckets) == ("fan" in sizes)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("scimap")]
    assert rounded(lm.score(docs, **sizes)) == rounded(lm.score(docs))
    assert rounded(substring.remove_repeats(docs, **sizes)) == rounded(substring.remove_repeats(docs))
    assert rounded(search.similar(docs, k=5, **sizes)) == rounded(search.similar(docs, k=5))


def test_messages_of_a_run(spark, docs):
    """A chunk gets an answer from each bucket or range at most, and totals are those of all words."""

    def words(chunk):
        h = np.array([xxhash.xxh64_intdigest(w) for t in chunk.texts() for w in t.split()], np.uint64)
        keys, n = np.unique(h, return_counts=True)
        return keys, [n.astype(np.uint64)]

    def count(sizes):
        c = chunks.chunked(docs, "doc_id", "text", **sizes)
        seen = []
        rule = chunks.Rule(chunks.summed, lambda merged, own: merged, lambda merged: (len(merged[0]), int(merged[1].sum())))
        answers = chunks.exchange(c, [], words, rule)
        for row in answers.where("chunk_id >= 0").collect():
            seen.append(len(row.answer))
        assert len(seen) == c.n_chunks and max(seen) <= c.ranges
        return tuple(chunks.sums_of(answers, 2).tolist())

    assert len({count(s) for s in ({}, *ROUTES)}) == 1


def test_passes_and_given_texts(spark, docs, monkeypatch):
    queries = table(spark, SF, "benchmark").select("item_id", "text")
    whole = rounded(search.search(docs, queries, k=5))
    assert whole
    monkeypatch.setattr(search, "PASS", 1 << 12)
    monkeypatch.setattr(search, "FILES", 2)
    assert rounded(search.search(docs, queries, k=5, chunk_bytes=64 << 10)) == whole


def test_cells_of_several_blocks(spark, docs, monkeypatch):
    whole = rounded(simhash.assign(docs).select("id", "component_id"))
    monkeypatch.setattr(simhash, "BLOCK", 2)
    assert rounded(simhash.assign(docs).select("id", "component_id")) == whole
