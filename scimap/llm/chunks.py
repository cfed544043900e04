"""Chunks of documents, and counts gathered over all chunks and brought back to each.

Operators on n-grams look at every occurrence of every n-gram. A row for each would make the shuffle many times the
input. Here a chunk (a few MB of text, compressed, in a table bucketed by chunk) sends its distinct keys once: sorted
64-bit hashes cut into buckets by their leading bits, as packed arrays. A bucket's task sees all chunks' keys of its
range, combines what they say, and answers each chunk in the order of the keys that it sent, so that answers carry no
keys. A key of any frequency is one entry in each chunk's message: there are no hot keys. The table is bucketed, so
answers are joined to it without moving texts again. Of very many buckets, chunks send to ranges by way of nodes, so
that messages don't grow with the square of the text; see route().
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scimap.llm.common import col, input_bytes, written

#: Bytes of text in a chunk, of all text for each bucket of keys, and of files for each partition.
CHUNK, BUCKET, PART = 8 << 20, 8 << 20, 64 << 20
#: Buckets of keys that a chunk sends to itself; of more, it sends to ranges of buckets.
FAN = 4096
MIX = np.uint64(0x9E3779B97F4A7C15)


def pack(values: np.ndarray) -> bytes:
    """Non-negative integers: their width in bytes, then the bytes in planes, compressed."""
    values = np.ascontiguousarray(values, dtype="<u8")
    top = int(values.max()) if len(values) else 0
    width = max(1, (top.bit_length() + 7) // 8)
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(data: bytes, n: int) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(pa.decompress(data[1:], n * width, codec="zstd", asbytes=True), np.uint8).reshape(width, n)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(unpack(data, n), dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(hashes: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of each `width` successive word hashes (by start); fewer words give none."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(salt), np.uint64)
    for k in range(width):
        out = mixed(out * MIX + hashes[k : k + n])
    return out


def _pack_chunks(batches: Iterator[pa.RecordBatch], chunk_bytes: int) -> Iterator[pa.RecordBatch]:
    """(id, text) -> (chunk_id, n_docs, n_bytes, ids, missing, sizes, data); ids are ascending, null ids last."""

    def chunk(rows: list) -> pa.RecordBatch:
        rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        sizes, data = [len(r[1]) for r in rows], b"".join([r[1] for r in rows])
        ids = [np.iinfo(np.int64).max if r[0] is None else r[0] for r in rows]
        cols = [[uuid.uuid4().int >> 65], [len(rows)], [len(data)], [np.array(ids, "<i8").tobytes()], [sum(r[0] is None for r in rows)], [np.array(sizes, "<u4").tobytes()], [pa.compress(data, codec="zstd", asbytes=True)]]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["chunk_id", "n_docs", "n_bytes", "ids", "missing", "sizes", "data"])

    held, size = [], 0
    for part in (batch.slice(i, 256) for batch in batches for i in range(0, batch.num_rows, 256)):
        for row in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            held.append((row[0], (row[1] or "").encode()))
            size += len(held[-1][1]) + 64
            if size >= chunk_bytes:
                yield chunk(held)
                held, size = [], 0
    if held:
        yield chunk(held)


@dataclass
class Kept:
    """What a table keeps of each chunk in place of its text: the row of named fields that keep(chunk) gives, of which an
    exchange reads `columns` and opens them by `view` for its send."""

    keep: Callable
    fields: list[tuple[str, pa.DataType]]
    columns: list[str]
    view: Callable


@dataclass
class Chunked:
    """A written table of chunks, its number of buckets of files, that of keys, the most of these that a chunk sends to itself, and what is kept of chunks."""

    table: DataFrame
    parts: int
    buckets: int
    n_chunks: int
    n_docs: int
    fan: int
    kept: Kept | None = None

    @property
    def ranges(self) -> int:
        """Parts that a chunk's keys are sent in; see route()."""
        return route(self.n_chunks, self.buckets, self.fan)[0]


def chunked(docs: DataFrame, id_col: str, text_col: str, chunk_bytes: int = CHUNK, bucket_bytes: int = BUCKET, fan: int | None = None, kept: Kept | None = None) -> Chunked:
    """docs' ids (integers) and texts (null: empty) as a written table of chunks, bucketed by chunk_id.

    kept: the table has what is kept of chunks, not their texts.

    chunk_bytes: the text of a chunk, which a task holds with its words and keys; a longer text is a chunk of its own.
    bucket_bytes: the text for each bucket of keys, which a task holds too. The table has a bucket of files for each PART
    bytes of docs' files (as many as Spark's bucketing allows), and as many as the session's shuffles have partitions at least.
    """
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = min(100_000, max(least, -(-(input_bytes(docs) or 0) // PART)))
    schema = "chunk_id bigint, n_docs bigint, n_bytes bigint, ids binary, missing bigint, sizes binary, data binary"
    rows = docs.select(col(id_col).cast("long").alias("id"), col(text_col).alias("text"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = _pack_chunks(batches, chunk_bytes)
        yield from chunks if kept is None else (_kept(c, kept) for c in chunks)

    if kept is not None:
        schema = ", ".join(["chunk_id bigint, n_docs bigint, n_bytes bigint", *[f"{c} {'bigint' if k == pa.int64() else 'binary'}" for c, k in kept.fields]])
    table = written(rows.mapInArrow(packed, schema), "chunk_id", parts)
    n, n_docs, n_bytes = (int(x or 0) for x in table.agg(F.count(F.lit(1)), F.sum("n_docs"), F.sum("n_bytes")).first())
    return Chunked(table, parts, n_bytes // bucket_bytes + 1, n, n_docs, fan or FAN, kept)


def _kept(chunk: pa.RecordBatch, kept: Kept) -> pa.RecordBatch:
    row = {n: c[0].as_py() for n, c in zip(chunk.schema.names, chunk.columns, strict=True)}
    head = [("chunk_id", pa.int64()), ("n_docs", pa.int64()), ("n_bytes", pa.int64())]
    return _arrow([(*[row[n] for n, _ in head], *kept.keep(Chunk(*[row[c] for c in COLUMNS[1:]])))], [*head, *kept.fields])


class Chunk:
    """A chunk's documents, from its row's bytes."""

    def __init__(self, ids: bytes, missing: int, sizes: bytes, data: bytes, n_bytes: int):
        self.ids = np.frombuffer(ids, "<i8")
        self.missing = missing
        self.ends = np.cumsum(np.frombuffer(sizes, "<u4"), dtype=np.int64)
        self.data = pa.decompress(data, n_bytes, codec="zstd", asbytes=True) if n_bytes else b""

    def texts(self) -> Iterator[bytes]:
        begin = 0
        for end in self.ends.tolist():
            yield self.data[begin:end]
            begin = end

    def id_array(self) -> pa.Array:
        """The ids, with nulls again."""
        missing = np.arange(len(self.ids)) >= len(self.ids) - self.missing
        return pa.array(self.ids, pa.int64(), mask=missing)


COLUMNS = ["chunk_id", "ids", "missing", "sizes", "data", "n_bytes"]


@dataclass
class Rule:
    """What an exchange does with keys and the n_values integers that each carries.

    merge(list of (keys, values...), each sorted by key) gives the list of merged arrays (keys, values...), sorted by
    key, and for each row of all parts its place among them. It may be applied again to what it has merged.
    settle(merged values, own values), aligned with a chunk's rows, gives the tuple of arrays that the chunk gets.
    totals(merged arrays) gives a tuple of numbers, which are summed over all buckets.
    """

    merge: Callable
    settle: Callable
    totals: Callable
    n_values: int = 1


def summed(parts: list) -> tuple[list[np.ndarray], np.ndarray]:
    """A merge: values are added up."""
    keys, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    sums = [np.bincount(back, np.concatenate([p[k] for p in parts]).astype(np.float64), len(keys)).astype(np.uint64) for k in range(1, len(parts[0]))]
    return [keys, *sums], back


def bucket_of_keys(keys: np.ndarray, buckets: int) -> np.ndarray:
    """By the leading bits, so that it ascends with the keys."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def route(n_chunks: int, buckets: int, fan: int = FAN) -> tuple[int, int, int]:
    """(ranges, buckets a range, groups of chunks); one range a bucket and no groups (0) if there are `fan` buckets at most.

    Each chunk sends to every bucket: messages grow with the square of the text, and each has fewer keys. Beyond fan
    buckets, chunks are put into groups, and a group's chunks send to its nodes, one for each range of buckets. A node
    merges what it gets and sends that to the buckets of its range. With as many ranges as buckets a range, n chunks and
    n buckets make about 2 n sqrt(n) messages instead of n^2.
    """
    if buckets <= fan:
        return buckets, 1, 0
    ranges = math.isqrt(buckets - 1) + 1
    return ranges, -(-buckets // ranges), max(1, -(-n_chunks // ranges))


def _arrow(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(cols, fields, strict=True)], names=[f for f, _ in fields])


def _cut(bucket: np.ndarray, keys: np.ndarray, values: list) -> Iterator[tuple]:
    """(bucket, n, packed keys, packed values...) of each bucket; bucket ascends."""
    begin = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
    for i, j in zip(begin.tolist(), np.append(begin, len(bucket))[1:].tolist(), strict=True):
        yield int(bucket[i]), j - i, pack_sorted(keys[i:j]), *[pack(v[i:j]) for v in values]


def exchange(chunks: Chunked, answers: list[DataFrame], send: Callable, rule: Rule) -> DataFrame:
    """One round of messages; the answers as a written table (chunk_id, answer), bucketed by chunk_id.

    send(chunk, *earlier answers) gives (sorted keys, list of arrays of integers aligned with them). A chunk's answer
    has a part for each bucket (or range of buckets) that it sent to, in order. Rows with a chunk_id below 0 have the
    totals of buckets.
    """
    ranges, each, groups = route(chunks.n_chunks, chunks.buckets, chunks.fan)
    buckets, parts, kept = ranges * each, chunks.parts, chunks.kept
    names = [f"v{i}" for i in range(rule.n_values)]
    message = [("bucket", pa.int64()), ("chunk_id", pa.int64()), ("n", pa.int64()), ("keys", pa.binary()), *[(v, pa.binary()) for v in names]]
    schema = "bucket bigint, chunk_id bigint, n bigint, keys binary, " + ", ".join(f"{v} binary" for v in names)
    answered = "chunk_id bigint, bucket bigint, answer binary"

    def sender(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk_id, chunk, given in opened(batches, kept):
            keys, values = send(chunk, *given)
            to = bucket_of_keys(keys, buckets) // np.uint64(each)
            first = chunk_id % groups * ranges if groups else 0
            yield _arrow([(first + b, chunk_id, *x) for b, *x in _cut(to, keys, values)], message)

    def opened_parts(rows: pd.DataFrame) -> list[tuple]:
        return [(unpack_sorted(r["keys"], r["n"]), *[unpack(r[v], r["n"]) for v in names]) for r in rows.to_dict("records")]

    def settled(merged: list, back: np.ndarray, parts: list) -> list[tuple]:
        """What each part gets."""
        own = [np.concatenate([p[k] for p in parts]) for k in range(1, rule.n_values + 1)]
        out = rule.settle([m[back] for m in merged], own)
        cuts = np.cumsum([len(p[0]) for p in parts])[:-1]
        return list(zip(*[np.split(x.astype(np.uint64), cuts) for x in out], strict=True))

    def in_bucket(rows: pd.DataFrame) -> pd.DataFrame:
        own = opened_parts(rows)
        merged, back = rule.merge(own)
        if groups:  # nodes get merged values
            cuts = np.cumsum([len(p[0]) for p in own])[:-1]
            found = list(zip(*[np.split(m[back], cuts) for m in merged[1:]], strict=True))
        else:
            found = settled(merged[1:], back, own)
        bucket = int(rows["bucket"].iloc[0])
        out = [(c, bucket, b"".join(_framed(pack(a)) for a in arrays)) for c, arrays in zip(rows["chunk_id"], found, strict=True)]
        out.append((-1 - bucket // 4096, bucket, np.array(rule.totals(merged), "<i8").tobytes()))
        return pd.DataFrame(out, columns=["chunk_id", "bucket", "answer"])

    def gathered(back: DataFrame) -> DataFrame:
        back = back.repartition(parts, "chunk_id").groupBy("chunk_id").agg(F.sort_array(F.collect_list(F.struct("bucket", "answer"))).alias("answer"))
        return written(back.select("chunk_id", F.col("answer.answer").alias("answer")), "chunk_id", parts)

    def in_node(rows: pd.DataFrame) -> pd.DataFrame:
        merged, _ = rule.merge(opened_parts(rows))
        kept = rows[["chunk_id", "n", "keys", *names]].to_dict("records")
        row = {"node": rows["bucket"].iloc[0], "rows": kept, "n": len(merged[0]), "keys": pack_sorted(merged[0])}
        return pd.DataFrame([row | {v: pack(m) for v, m in zip(names, merged[1:], strict=True)}])

    def node_sender(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                keys = unpack_sorted(r["keys"], r["n"])
                cut = _cut(bucket_of_keys(keys, buckets), keys, [unpack(r[v], r["n"]) for v in names])
                yield _arrow([(b, r["node"], *x) for b, *x in cut], message)

    def from_node(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                own = opened_parts(pd.DataFrame(r["rows"]))
                back = rule.merge(own)[1]
                for_chunks = settled(answer_for(unpack_sorted(r["keys"], r["n"]), r["answer"], buckets), back, own)
                rows = [(x["chunk_id"], r["node"] % ranges, b"".join(_framed(pack(a)) for a in arrays)) for x, arrays in zip(r["rows"], for_chunks, strict=True)]
                yield _arrow(rows, [("chunk_id", pa.int64()), ("bucket", pa.int64()), ("answer", pa.binary())])

    sent = joined(chunks, answers).mapInArrow(sender, schema).repartition(parts, "bucket")
    if not groups:
        return gathered(sent.groupBy("bucket").applyInPandas(in_bucket, answered))
    values = ", ".join(f"{v} binary" for v in names)
    kept = f"rows array<struct<chunk_id: bigint, n: bigint, keys: binary, {values.replace(' binary', ': binary')}>>"
    nodes = written(sent.groupBy("bucket").applyInPandas(in_node, f"node bigint, {kept}, n bigint, keys binary, {values}"), "node", parts)
    back = gathered(nodes.drop("rows").mapInArrow(node_sender, schema).repartition(parts, "bucket").groupBy("bucket").applyInPandas(in_bucket, answered))
    settled_rows = nodes.select("node", "rows", "n", "keys").join(back.withColumnRenamed("chunk_id", "node"), "node").mapInArrow(from_node, answered)
    totals = back.where("chunk_id < 0").select("chunk_id", F.lit(0).cast("long").alias("bucket"), F.explode("answer").alias("answer"))
    return gathered(settled_rows.union(totals))


def _framed(data: bytes) -> bytes:
    return len(data).to_bytes(4, "little") + data


def arrays_of(answer: list[bytes], sizes: list[int]) -> list[np.ndarray]:
    """An answer's arrays, over all buckets in order; sizes: the keys that were sent to each of them."""
    out: list[list[np.ndarray]] = []
    for data, n in zip(answer, sizes, strict=True):
        at, k = 0, 0
        while at < len(data):
            size = int.from_bytes(data[at : at + 4], "little")
            if k == len(out):
                out.append([])
            out[k].append(unpack(data[at + 4 : at + 4 + size], n))
            at, k = at + 4 + size, k + 1
    return [np.concatenate(x) for x in out]


def answer_for(keys: np.ndarray, answer: list[bytes] | None, buckets: int) -> list[np.ndarray]:
    """The arrays of an answer, aligned with the keys that were sent to so many buckets (or ranges of buckets)."""
    bucket = bucket_of_keys(keys, buckets)
    sizes = np.unique(bucket, return_counts=True)[1].tolist()
    return arrays_of(answer or [], sizes)


def sums_of(answers: DataFrame, k: int) -> np.ndarray:
    """The sums over all buckets of the k totals of an exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i8").reshape(-1, k).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()) for i in rows.tolist()], names=[f"t{i}" for i in range(k)])

    rows = answers.where("chunk_id < 0").select(F.explode("answer").alias("t")).mapInArrow(run, ", ".join(f"t{i} bigint" for i in range(k)))
    return np.array([x or 0 for x in rows.agg(*[F.sum(f"t{i}") for i in range(k)]).first()], np.int64)


def joined(chunks: Chunked, answers: list[DataFrame]) -> DataFrame:
    """The chunks with their answers as columns a0, a1, ..."""
    out = chunks.table.select(*(chunks.kept.columns if chunks.kept else COLUMNS))
    for i, a in enumerate(answers):
        out = out.join(a.select("chunk_id", F.col("answer").alias(f"a{i}")), "chunk_id", "left")
    return out


def opened(batches: Iterator[pa.RecordBatch], kept: Kept | None = None) -> Iterator[tuple[int, Chunk, list]]:
    """The chunks of joined() (or the views of what is kept of them), one at a time, with their answers."""
    n, view = (len(kept.columns), kept.view) if kept else (len(COLUMNS), Chunk)
    for batch in batches:
        for i in range(batch.num_rows):
            row = [c[i].as_py() for c in batch.columns]
            yield row[0], view(*row[1:n]), row[n:]
