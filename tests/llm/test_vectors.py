"""Vector codes and centroid clusters against plain loops in Python's integers, and their edges."""

import hashlib
import random
from math import floor, inf, isfinite, nan

import numpy as np
import pytest
from pyspark.sql import functions as F

from scimap.llm import centroids, codes

SCHEMA = "vec_id bigint, embedding array<float>, label int"
CLASHES = ["id", "code", "error", "label_error", "cluster", "distance", "inertia", "centroid", "v", "_key", "_n", "ids", "labels", "components", "a.b"]


def vectors(n, length, seed, spread=0.5):
    r = random.Random(seed)
    f = lambda: float(np.float32(r.uniform(-spread, spread)))
    rows = [(i, [f() for _ in range(length)], r.choice([0, 0, 0, 1, 2, None])) for i in r.sample(range(10 * n), n)]
    rows += [(rows[i][0] + 10 * n, rows[i][1], rows[i][2]) for i in range(n // 4)]  # copies
    odd = [(7, None, 1), (8, [None] * length, 1), (9, [nan] * length, 2), (10, [inf] + [0.0] * (length - 1), 0), (11, [0.0] * (length - 1) + [-inf], 0), (12, [], 0), (13, [0.5] * (length + 1), 0)]
    return rows + [(20 * n + i, v, label) for i, v, label in odd]


def good(rows, length):
    return [r for r in rows if r[1] is not None and len(r[1]) == length and all(x is not None and isfinite(x) for x in r[1])]


def square(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def moved(old, groups):
    return [[sum(c) // len(g) for c in zip(*g, strict=True)] if g else o for o, g in zip(old, groups, strict=True)]


def plain_codes(rows, length, parts, entries, rounds, scale):
    own = [(i, [floor(scale * x) for x in v], label) for i, v, label in good(rows, length)]
    w = length // parts
    cut = lambda v: [tuple(v[p * w : p * w + w]) for p in range(parts)]
    books = list(zip(*[cut(v) for _, v, _ in sorted(own, key=lambda r: (r[0], r[1]))[:entries]], strict=True))
    near = lambda x, p: min(range(len(books[p])), key=lambda e: (square(x, books[p][e]), e))
    for _ in range(rounds):
        groups = [[[] for _ in b] for b in books]
        for _, v, _ in own:
            for p, x in enumerate(cut(v)):
                groups[p][near(x, p)].append(x)
        books = [moved(b, g) for b, g in zip(books, groups, strict=True)]
    out, sums = [], {}
    for i, v, label in own:
        code = [near(x, p) for p, x in enumerate(cut(v))]
        error = sum(square(x, books[p][e]) for p, (x, e) in enumerate(zip(cut(v), code, strict=True)))
        sums[label] = sums.get(label, 0) + error
        out.append((i, label, "".join(f"{e:02x}" for e in code), error))
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return [(*r, sums[r[1]]) for r in out], sha


@pytest.mark.parametrize(("length", "parts", "entries", "block"), [(8, 4, 5, 7), (16, 16, 9, 4096), (6, 2, 64, 3)])
def test_codes_equal_plain_loops(spark, length, parts, entries, block):
    rows = vectors(40, length, length)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got, books = codes.compress(df, parts=parts, entries=entries, scale=16, block=block)
    want, sha = plain_codes(rows, length, parts, entries, 2, 16)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert books.sha256() == sha and books.entries.shape == (parts, min(entries, 50), length // parts)


def test_codes_sums_beyond_64_bits():
    a = np.array([1 << 62, -(1 << 62), 5])
    assert codes._add(codes._add(a, a), a).tolist() == [3 << 62, -(3 << 62), 15]


def test_label_sums_of_rare_labels(spark):
    """With a share of 2, no label is broadcast, or one is: the sums are the same."""
    from scimap.llm.common import with_group_sum, written

    df = written(spark.createDataFrame([(i, None if i % 5 == 0 else i % 3, i) for i in range(60)], "id int, label int, error bigint"))
    for share in (1, 2, 4, 1024):
        rows = with_group_sum(df, "label", "error", "s", share).collect()
        want = {}
        for r in rows:
            want[r.label] = want.get(r.label, 0) + r.error
        assert len(rows) == 60 and all(r.s == want[r.label] for r in rows)


def plain_clusters(rows, length, k, rounds, scale, seed):
    own = [(i, [floor(scale * x) for x in v]) for i, v, _ in good(rows, length)]
    first = sorted(own, key=lambda r: (hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    means = [v for _, v in first]
    near = lambda v: min(range(len(means)), key=lambda c: (square(v, means[c]), c))
    for _ in range(rounds):
        groups = [[] for _ in means]
        for _, v in own:
            groups[near(v)].append(v)
        means = moved(means, groups)
    found = [(i, c := near(v), square(v, means[c])) for i, v in own]
    total = {}
    for _, c, d in found:
        total[c] = total.get(c, 0) + d
    return [(i, c, d, total[c], sum(total.values()), means[c]) for i, c, d in found]


@pytest.mark.parametrize(("k", "rounds"), [(4, 3), (16, 1), (70, 2)])
def test_clusters_equal_plain_loops(spark, k, rounds):
    rows = vectors(40, 8, k)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = [tuple(r) for r in centroids.cluster(df, k=k, length=8, rounds=rounds, scale=8).collect()]
    assert sorted(got) == sorted(plain_clusters(rows, 8, k, rounds, 8, 1))


def test_edges(spark):
    rows = [(None, [0.25] * 16, None), (None, [0.25] * 16, None), (1, [0.0] * 16, 0), (1, [0.0] * 16, 0), (1, [0.5] * 16, 0), (2, [-0.001] * 16, 3)]
    df = spark.createDataFrame(rows, SCHEMA)
    wide = df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHES)]).withColumnRenamed("vec_id", "the.id").withColumnRenamed("embedding", "the.vector").withColumnRenamed("label", "the.label")
    got, books = codes.compress(wide, "the.id", "the.vector", "the.label")
    want, sha = plain_codes([(r[0] if r[0] is not None else 10**9, *r[1:]) for r in rows], 16, 16, 64, 2, 256)
    assert sorted((r.code, r.error, r.label_error) for r in got.collect()) == sorted(r[2:] for r in want) and books.sha256() == sha
    assert sum(r.id is None for r in got.collect()) == 2
    got = centroids.cluster(wide, "the.id", "the.vector", k=3, length=16).collect()
    assert len(got) == 6 and sum(r.id is None for r in got) == 2 and {r.inertia for r in got} == {sum(r.distance for r in got)}
    none = df.where("vec_id = 99")
    got, books = codes.compress(none)
    assert got.count() == 0 and books.entries.size == 0 and centroids.cluster(none, length=16).count() == 0
    assert codes.compress(df.where("vec_id = 1"))[0].count() == 3
    far = spark.createDataFrame([(1, [1e30] * 16, 0)], SCHEMA)
    with pytest.raises(Exception, match="no exact distances"):
        codes.compress(far)
    with pytest.raises(Exception, match="no exact distances"):
        centroids.cluster(far, length=16)


def test_plans(spark):
    """Vectors don't move; clusters' sums do."""
    df = spark.createDataFrame(vectors(20, 8, 1), SCHEMA)
    table = centroids.integers(df, "vec_id", "embedding", 8, 64)
    assert "Exchange" not in table._jdf.queryExecution().toString()
    text = codes.encoded(codes.blocks_of(df, "vec_id", "embedding", "label", 8, 256, 4), codes.Codebooks(np.zeros((4, 2, 2), np.int64), 256))._jdf.queryExecution().toString()
    assert "Exchange" not in text
