"""Packing: whole documents by the tokenizers library, full sequences, proportions, deficits over stretches, edges."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scimap.llm import packing

SCHEMA = "doc_id bigint, text string, source string"


def texts_of(rows):
    t = Tokenizer.from_file(packing.default_path())
    t.encode_special_tokens = True
    return [[*t.encode(text or "", add_special_tokens=False).ids, 0] for _, text, _ in rows]


def held(rows, pieces, window=1024):
    """That the pieces are the rows' ids, once each, in gapless sequences; gives (sequence, source) -> tokens, and lengths."""
    want = sorted((r[0] or -1, r[2] or "", tuple(ids)) for r, ids in zip(rows, texts_of(rows), strict=True))
    sequences, mixture, docs = {}, {}, {}
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u4").tolist()
        assert len(ids) == p.length > 0
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
        mixture[p.sequence_id, p.source] = mixture.get((p.sequence_id, p.source), 0) + p.length
        docs.setdefault((p.id or -1, p.source or "", p.doc_tokens), []).append((p.start, ids))
    lengths = []
    for s in range(len(sequences)):
        at = 0
        for offset, length in sorted(sequences[s]):
            assert offset == at
            at += length
        lengths.append(at)
    rest = sum(map(lambda r: len(r[2]), want)) % window
    assert lengths == [window] * (len(lengths) - rest.bit_count()) + [1 << b for b in range(10, -1, -1) if rest >> b & 1], rest
    got = []
    for (i, source, n), parts in docs.items():
        parts.sort()
        copies = sum(start == 0 for start, _ in parts)
        flat = [x for _, ids in parts for x in ids] if copies == 1 else None
        if flat is None:  # repeated rows: each position as often as there are rows
            assert sorted(start + k for start, ids in parts for k in range(len(ids))) == sorted(list(range(n)) * copies)
            whole = {start + k: x for start, ids in parts for k, x in enumerate(ids)}
            got += [(i, source, tuple(whole[k] for k in range(n)))] * copies
        else:
            got.append((i, source, tuple(flat)))
    assert sorted(got) == want
    return mixture, lengths


def corpus(n=300):
    r = np.random.default_rng(5)
    words = ["alpha", "Beta,", "gamma's", "δέλτα", "12345", "x\ny", "a  b", "漢字", "<|endoftext|>", "tab\tbed"]
    sources = ["web"] * 12 + ["books"] * 5 + ["code"] * 2 + [None]
    return [(i, " ".join(r.choice(words, int(r.integers(0, 400)))), sources[int(r.integers(0, 20))]) for i in range(n)]


@pytest.mark.parametrize(("window", "grain", "stretch"), [(1024, 64, 256), (256, 32, 3), (64, 1, 1)])
def test_pack(spark, window, grain, stretch):
    rows = corpus()
    pieces = packing.pack(spark.createDataFrame(rows, SCHEMA).repartition(4), window=window, grain=grain, stretch=stretch).collect()
    mixture, lengths = held(rows, pieces, window)
    total = sum(lengths)
    share = {}
    for (_, source), n in mixture.items():
        share[source] = share.get(source, 0) + n
    for source, n in share.items():
        due, seen = window * n / total, 0
        for s, length in enumerate(lengths):
            if length == window:
                own = mixture.get((s, source), 0)
                assert abs(own - due) <= 2 * grain + 2
                seen += own
                assert abs(seen - due * (s + 1)) <= 2 * grain + 2  # deficits are carried, over stretches too


def test_closed_forms():
    """Queues' places add up to the tape at every stretch, documents find their stretches, and turns send what is due."""
    totals, size, window = [7, 977, 42, 3000, 43], 96, 32  # all but the first have a token a stretch
    all_, lo, at = sum(totals), [], 0
    for t in totals:
        lo.append(at)
        at += t
    for k in range(-(-all_ // size)):
        stop = min(all_, (k + 1) * size)
        lengths = [packing.due(stop, b, t, all_) - packing.due(k * size, b, t, all_) for b, t in zip(lo, totals, strict=True)]
        assert sum(lengths) == stop - k * size
        for grain in (1, 8, 100):
            for b, t, n in zip(lo, totals, lengths, strict=True):
                sent = list(packing.turns(k, size, window, grain, b, t, all_))
                assert sum(x for _, x in sent) == n and all(x > 0 for _, x in sent) and [r for r, _ in sent] == sorted({r for r, _ in sent})
    for b, t in zip(lo, totals, strict=True):
        for begin in range(0, t, 7):
            got = list(packing.stretches(begin, min(7, t - begin), b, t, all_, size))
            assert [g[2] for g in got] == [0, *[g[3] for g in got][:-1]] and got[-1][3] == min(7, t - begin)
            for k, place, x, y in got:
                assert packing.due(k * size, b, t, all_) + place == begin + x
                assert packing.due(min(all_, (k + 1) * size), b, t, all_) >= begin + y
    assert packing.sequence_ends(2048 + 7, 1024) == [1024, 2048, 2052, 2054, 2055] and packing.sequence_ends(5, 1024) == [4, 5]


def test_ids_equal_those_of_the_library(tmp_path):
    """Every code point in several places, odd white space, long texts in parts; files of other kinds go to the library."""
    tokens, t = packing.load(packing.default_path()), Tokenizer.from_file(packing.default_path())
    assert tokens.ranked
    t.encode_special_tokens = True
    plain = lambda texts: [np.array(e.ids, tokens.dtype).tobytes() for e in t.encode_batch_fast(texts, add_special_tokens=False)]
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 1 << 16):
        texts = [f"a{c}1{c}{c} {c}b.{c} {c}{c}\n{c}" for c in points[at : at + (1 << 16) : 3 if at else 1]]
        assert list(map(tokens.encode, texts)) == plain(texts)
    long = "some words, 42 and\nmore " * 100_000 + "y" * 1_200_000 + " " * 50_000 + "<|endoftext|>"
    assert len(list(packing.parts(long))) == 3 and tokens.encode(long) == plain([long])[0]
    space = "".join(c for c in points if c.isspace())
    texts = [f"one{a} two {b}three {a}{b} four" for a in space for b in " x\t"]
    assert [b"".join(map(tokens.encode, packing.parts(x, 1))) for x in texts] == plain(texts)
    import json

    spec = json.load(open(packing.default_path()))
    spec["normalizer"] = {"type": "Lowercase"}
    (tmp_path / "other.json").write_text(json.dumps(spec))
    other = packing.Tokens(str(tmp_path / "other.json"))
    assert not other.ranked and other.encode("Ab CD") == tokens.encode("ab cd")


def test_rare_sources(spark):
    """Sources with less than a token a stretch share a queue."""
    rows = corpus(150) + [(1000 + i, "x " * (i % 7), f"rare{i}") for i in range(40)]
    pieces = packing.pack(spark.createDataFrame(rows, SCHEMA).repartition(3), window=32, grain=4, stretch=2).collect()
    held(rows, pieces, 32)


def test_edges(spark):
    long = "word " * 250_000
    rows = [(1, None, None), (2, "", "s"), (3, long, "s"), (3, long, "s"), (None, "no id", None), (None, None, None), (4, "x", "t"), (4, "x", "t")]
    df = spark.createDataFrame(rows, SCHEMA)
    clashes = ["part", "queue", "before", "id", "n", "ids", "at", "lo", "total", "all", "stretch", "place", "places", "offset", "a.b"]
    wide = df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(clashes)]).withColumnsRenamed({"doc_id": "the.id", "text": "the.text", "source": "the.source"})
    out = packing.pack(wide, "the.id", "the.text", "the.source", stretch=16)
    pieces = out.collect()
    _, lengths = held(rows, pieces)
    assert packing.pack(df.where("doc_id = 99")).count() == 0
    one = packing.pack(df.where("doc_id = 2")).collect()
    assert [(p.length, p.sequence_id, p.offset, p.doc_tokens) for p in one] == [(1, 0, 0, 1)]
    whole = {r.sequence_id: r for r in packing.sequences(out).collect()}
    assert [len(whole[s].ids) for s in range(len(lengths))] == [4 * n for n in lengths] and all(r.ends[-1] * 4 == len(r.ids) for r in whole.values())
