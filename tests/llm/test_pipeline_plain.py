"""The pipeline's rows against a plain version of all five stages: which ids stay, how often, and their token ids."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from scimap.llm import bpe, quality
from scimap.llm.common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACE = " \t\n\x0b\x0c\r"


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def good(docs, labels):
    """Those that a quadratic discriminant of half pooled covariances scores 0.7 or more: densities by solving, not by factors."""
    x = {k: [] for k in (0, 1)}
    for i, _, text in docs:
        if labels.get(i) in x and zlib.crc32(str(i).encode()) % 4 != 2:
            x[labels[i]].append(quality.statistics(text))
    x = {k: np.array(v) for k, v in x.items()}
    n = sum(map(len, x.values()))
    own = {k: np.cov(v.T, bias=True) for k, v in x.items()}
    pooled = sum(len(x[k]) * own[k] for k in x) / n

    def density(k, s):
        c = (own[k] + pooled) / 2 + 1e-6 * np.eye(len(s))
        off = s - x[k].mean(axis=0)
        return math.log(len(x[k]) / n) - (np.linalg.slogdet(c)[1] + off @ np.linalg.solve(c, off)) / 2

    out = []
    for row in docs:
        s = np.array(quality.statistics(row[2]))
        if 1 / (1 + math.exp(min(500, density(0, s) - density(1, s)))) >= 0.7:
            out.append(row)
    return out


def without_lines(docs):
    where = {}
    for i, _, text in docs:
        for line in text.split("\n"):
            where.setdefault(lower(line.strip(SPACE)), set()).add(i)
    gone = {k for k, ids in where.items() if k and len(ids) >= 10}
    return [(i, s, "\n".join(x for x in t.split("\n") if lower(x.strip(SPACE)) not in gone)) for i, s, t in docs]


def one_of_each(docs):
    prints = []
    for _, _, text in docs:
        words = WORD.findall(lower(text))
        shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    seen, kept = set(), []
    for first in sorted(range(len(docs)), key=lambda k: docs[k][0]):
        if first in seen:
            continue
        kept.append(docs[first])
        todo = [first]
        while todo:
            k = todo.pop()
            if k not in seen:
                seen.add(k)
                todo += [j for j in range(len(docs)) if j not in seen and (prints[k] ^ prints[j]).bit_count() <= 3]
    return kept


def highest_quotients(weights, seats):
    got = dict.fromkeys(weights, 0)
    for _ in range(seats):
        got[min(weights, key=lambda k: (-weights[k] / (2 * got[k] + 1), k))] += 1
    return got


def mixed(spark, docs):
    """Each row as often as the mix takes it. Seeded hashes are Spark's; everything else is counted out."""
    d = spark.createDataFrame(docs, "id bigint, source string, text string").withColumn("th", F.xxhash64("text"))
    hashes = {r.id: r for r in d.select("id", "th", F.xxhash64(F.lit(8), "id", "th").alias("order")).collect()}
    start = {r.source: r for r in d.select("source", *[F.xxhash64(F.lit(k), "source", F.lit(0).cast("long")).alias(f"s{k}") for k in (9, 10)]).distinct().collect()}
    size = {i: len(WORD.findall(t)) for i, _, t in docs}
    total = Counter()
    for i, s, _ in docs:
        total[s] += size[i]
    assert max(total.values()) < 1 << 19  # one shard a source
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(total))}
    target, open_ = {}, set(total)
    while open_:
        level = (sum(total.values()) - sum(target.values())) / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 3 * total[s]}
        target |= {s: 3.0 * total[s] for s in full} if full else {s: level * weight[s] for s in open_}
        open_ = open_ - full if full else set()
    blocks = highest_quotients(target, math.floor(sum(total.values()) / 16 + 0.5))
    times = {}
    for s in total:
        own = [i for i, x, _ in docs if x == s]
        n, words = max(1, -(-total[s] // 16)), blocks[s] * 16
        passes = min(3, words // total[s])
        rest = min(n, math.floor((words - passes * total[s]) / 16 + 0.5)) if passes < 3 else 0
        begin = start[s].s9 % n
        more = [((b + 1) * rest + begin) // n > (b * rest + begin) // n for b in range(n)]
        at, part, taken = 0, {}, {}
        for i in sorted(own, key=lambda i: (hashes[i].order, i, hashes[i].th)):
            taken[i] = passes * size[i] + sum(more[k // 16] for k in range(at, at + size[i]))
            part[i] = taken[i] % size[i] * 32768 // size[i] if size[i] else 0
            at += size[i]
        sum_ = start[s].s10 % 32768
        for i in sorted(own, key=lambda i: (size[i], hashes[i].order, i, hashes[i].th)):
            sum_ += part[i]
            times[i] = taken[i] // size[i] + sum_ // 32768 - (sum_ - part[i]) // 32768 if size[i] else 1
    return [row for row in docs for _ in range(times[row[0]])]


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_rows_equal_a_plain_pipeline(spark, sf):
    docs = [(r.doc_id, r.source, r.text or "") for r in table(spark, sf, "documents").collect()]
    labels = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    rows = mixed(spark, one_of_each(without_lines(good(docs, labels))))
    encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load(bpe.default_path(), bpe.default_pattern()).ranks, special_tokens={}).encode_ordinary
    want = Counter()
    for i, source, text in rows:
        ids = np.array(encode(text), "<u4").tobytes()
        want[i, source, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
    got = Counter((r.doc_id, r.source, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, sf).collect())
    assert got == want and len({k[0] for k in want}) < len(docs)
