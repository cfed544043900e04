"""SimHash near-duplicates: fingerprints, exact links within a radius by bit-sliced comparison, and their components.

Distinct fingerprints only are compared. Two that differ in at most 3 of 64 bits agree in at least two of five bit
blocks, so each fingerprint is put into ten cells, one for each pair of blocks; every link is met in some cell.
A task holds cells in a row as bit planes: bit p of all fingerprints as one bit vector. Comparing every fingerprint
with the d-th after it is then an exclusive or of each plane with itself shifted by d, and saturating carry-save
counters add up 64 distances in a machine word; words where all are beyond the radius are abandoned early. A cell of
very many fingerprints is dealt in blocks to several tasks. Only links that join two parts are emitted.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scimap.llm.arrow import with_text_columns
from scimap.llm.common import col, fresh, meet, written

#: Fingerprints of a cell that one task compares with each other.
BLOCK = 2048
#: Rows that a task gathers before it compares, whole cells at a time.
GATHER = 1 << 16
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    """The majority of the bits of the hashes of all shingles (repeats count), as a signed 64-bit integer; no words: 0."""
    tokens = text.encode().lower().split()
    if not tokens:
        return 0
    if len(tokens) < words:
        hashes = [xxhash.xxh64_intdigest(b" ".join(tokens), seed)]
    else:
        row, digest = b" ".join(tokens), xxhash.xxh64_intdigest
        ends = list(accumulate([len(t) + 1 for t in tokens], initial=-1))
        hashes = [digest(row[a + 1 : b], seed) for a, b in zip(ends, ends[words:], strict=False)]
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    counts = bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, text_col: str = "text", words: int = 3) -> DataFrame:
    """docs with fp (bigint) in place of the text."""

    def make():
        return lambda texts: [pa.array([fingerprint(t, words) for t in texts], pa.int64())]

    return with_text_columns(docs, text_col, [T.StructField("fp", T.LongType())], make, drop=True)


def near_links(fps: np.ndarray, starts: np.ndarray, radius: int = 3) -> list[tuple[int, int]]:
    """A spanning forest of the links in each cell: index pairs into fps (unsigned).

    starts: where the cells begin, ascending, from 0. Only links of fingerprints not yet joined are returned.
    """
    sizes = np.diff(np.append(starts, len(fps)))
    by_size = np.argsort(-sizes, kind="stable")
    order = np.concatenate([np.arange(starts[c], starts[c] + sizes[c]) for c in by_size]) if len(by_size) else np.zeros(0, int)
    sizes = sizes[by_size]
    x, cell = fps[order], np.repeat(np.arange(len(sizes)), sizes)
    n, pos = len(x), np.arange(len(x)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    width = (n + 63) // 64 + 1
    planes = np.zeros((64, width), np.uint64)
    for p in range(64):
        packed = np.packbits((x >> np.uint64(p)).astype(np.uint8) & 1, bitorder="little")
        planes[p].view(np.uint8)[: len(packed)] = packed
    root, parts, out = np.arange(n), sizes.copy(), []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    rows_of = np.cumsum(sizes)
    for d in range(1, int(sizes[0]) if len(sizes) else 0):
        open_ = (sizes > d) & (parts > 1)
        if not open_.any():
            break
        last = rows_of[np.flatnonzero(open_)[-1]]
        valid = open_[cell[:last]] & (pos[:last] + d < sizes[cell[:last]])
        packed = np.packbits(valid, bitorder="little")
        alive = np.zeros((len(packed) + 7) // 8, np.uint64)
        alive.view(np.uint8)[: len(packed)] = packed
        at = np.flatnonzero(alive)
        alive, q, r = alive[at], d // 64, d % 64
        ones = np.zeros(len(at), np.uint64)
        twos, over = ones.copy(), ~alive
        for g in range(0, 64, 8):
            here = planes[g : g + 8, at]
            there = planes[g : g + 8, np.minimum(at + q, width - 1)]
            if r:
                there = (there >> np.uint64(r)) | (planes[g : g + 8, np.minimum(at + q + 1, width - 1)] << np.uint64(64 - r))
            for bit in here ^ there:
                carry = ones & bit
                ones ^= bit
                more = twos & carry
                twos ^= carry
                over |= more
                if radius < 3:
                    over |= (twos & ones) if radius == 2 else twos
            keep = over != ALL
            if not keep.all():
                at, ones, twos, over = at[keep], ones[keep], twos[keep], over[keep]
                if not len(at):
                    break
        if not len(at):
            continue
        near = np.unpackbits((~over).view(np.uint8), bitorder="little").reshape(-1, 64)
        w, b = np.nonzero(near)
        for i in (at[w] * 64 + b).tolist():
            a, c = find(i), find(i + d)
            if a != c:
                root[c] = a
                parts[cell[i]] -= 1
                out.append((int(order[i]), int(order[i + d])))
    return out


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cell, i, j, fp), sorted -> links (a, b)."""

    def links(rows: np.ndarray) -> pa.RecordBatch:
        new = np.append(True, (rows[1:, :3] != rows[:-1, :3]).any(axis=1))
        found = near_links(rows[:, 3].view(np.uint64), np.flatnonzero(new))
        a, b = (rows[[x[k] for x in found], 3] for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    held, n = [], 0
    for batch in batches:
        held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1))
        n += len(held[-1])
        if n >= GATHER:
            rows = np.concatenate(held)
            change = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1))
            if len(change):
                cut = change[-1] + 1
                yield links(np.ascontiguousarray(rows[:cut]))
                rows = rows[cut:]
            held, n = [rows], len(rows)
    if n:
        yield links(np.ascontiguousarray(np.concatenate(held)))


def cells(distinct: DataFrame, radius: int = 3, blocks: int = 5) -> DataFrame:
    """(fp) -> (cell, i, j, fp): the cells of each fingerprint, for each pair of blocks that it is part of.

    A pair within the radius agrees in blocks - radius blocks at least.
    """
    cuts = [round(64 * k / blocks) for k in range(blocks + 1)]
    keys = []
    for k, pick in enumerate(combinations(range(blocks), blocks - radius)):
        key = F.lit(k).cast("long")
        for b in pick:
            bits = cuts[b + 1] - cuts[b]
            key = F.shiftleft(key, bits).bitwiseOR(F.shiftrightunsigned("fp", cuts[b]).bitwiseAND(F.lit((1 << bits) - 1)))
        keys.append(key)
    c = distinct.select("fp", F.explode(F.array(*keys)).alias("cell"))
    n = c.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    c = c.join(n, "cell").withColumn("nb", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("fp"), F.col("nb")).cast("int"))
    c = c.withColumn("other", F.explode(F.expr("sequence(0, nb - 1)")))
    return c.select("cell", F.least("block", "other").cast("long").alias("i"), F.greatest("block", "other").cast("long").alias("j"), "fp")


def links(distinct: DataFrame, radius: int = 3) -> DataFrame:
    """(fp) of distinct fingerprints -> (a, b): links whose components are those of all links within the radius."""
    if radius != 3:
        raise ValueError("cells are cut for a radius of 3")
    c = cells(distinct, radius).repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", "fp")
    return c.mapInArrow(_link, "a bigint, b bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (node, root): the smallest node of its component for each node that has an edge.

    Rounds of large stars and small stars: a node's greater (then its smaller) neighbours are linked to its smallest
    neighbour. A hub's neighbours are never gathered: smallest neighbours are aggregated and joined back.
    """

    def smallest(e: DataFrame) -> DataFrame:
        return e.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))

    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, before = written(edges, small=True), None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(smallest(both), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        small = low.join(smallest(low), "a")
        small = small.select(F.explode(F.array(F.struct(F.col("a").alias("x"), "m"), F.struct(F.col("b").alias("x"), "m"))).alias("e"))
        edges = written(small.select(F.col("e.x").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct(), small=True)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, text_hash, fp, root, component_id, first): each document's fingerprint and component.

    component_id is the smallest id in the component; first is struct<no_id, id, text_hash> of the document that
    stands for it. Null and empty texts, and those of white space, have fingerprint zero and are linked like any
    other. Null ids are documents too: they link, but only name a component (null) that has no other. Repeated rows
    have equal fingerprints and so one component. An empty table gives no rows.
    """
    d = docs.select(col(id_col).alias("id"), col(text_col).alias("text"), F.xxhash64(col(text_col)).alias("text_hash"))
    d = written(fingerprints(d, "text", words))
    who = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash")).alias("first")
    distinct = written(d.groupBy("fp").agg(who), small=True)
    roots = components(links(distinct.select("fp")))
    of = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    of = written(of, small=True)
    firsts = of.groupBy("root").agg(F.min("first").alias("first"))
    of = of.select("fp", "root").join(firsts, "root")
    return d.join(of, "fp").select("id", "text_hash", "fp", "root", F.col("first.id").alias("component_id"), "first")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """One document of each component: that with the smallest id (of repeated ids, the smallest text hash). Columns as docs."""
    th, own, own_th = fresh(docs, "text_hash", "own_id", "own_hash")
    a = written(assign(docs, id_col, text_col, words).select("id", "text_hash", "root", "first"), small=True)
    first = written(a.select("root", "first").distinct().select(F.col("first.id").alias(own), F.col("first.text_hash").alias(own_th)), small=True)
    kept = meet(docs.withColumn(th, F.xxhash64(col(text_col))), first, col(id_col).eqNullSafe(F.col(own)) & (F.col(th) == F.col(own_th)), "left_semi")
    if not a.groupBy("id", "text_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        kept = kept.withColumn(own, col(id_col)).dropDuplicates([own, th])
    return kept.select(*[col(c) for c in docs.columns])
