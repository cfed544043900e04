"""Packing: sequences filled by deficit round-robin over source queues.

Every document's tokens go to a sequence once, so the mixture that all sequences can share is that of the whole corpus:
each source has a window's tokens in proportion to all of its tokens. The documents of a source, one after the other,
are its queue. In a round, a window long, each queue's deficit grows by its share of a window; where it covers a grain
the queue sends so many whole grains, and keeps the rest of its deficit for later rounds. (Queues whose share is a grain
or more send all whole tokens that they are due.) What the queues send, in order, is a tape, cut at each window.

The tape is dealt in stretches of many windows. A queue's place at the beginning of a stretch is a closed form (its share
of the tape so far, rounded so that the queues add up), and so is the deficit that it brings along from the stretch
before. So stretches are filled by themselves, each from the part of every queue that belongs to it, and no task sees
more than a stretch. Tokens move once.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from scimap.llm.common import col, input_bytes, written

#: A space between two other characters: byte-level BPE begins a new match there, whatever stands around it.
CUT = re.compile(r" (?<=\S )(?=\S)")
#: Longer texts are encoded in parts of about so many characters.
PART = 1 << 20
#: White space of which tiktoken's search could run out of stack.
RUN = re.compile(r"\s{20000}")
#: The split pattern of byte-level BPE where its file says use_regex (fixed values).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it can be printed, else one from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}


class Tokens:
    """Ids by a file of the tokenizers library, as packed integers of dtype. Special tokens' strings in a text are ordinary text.

    Byte-level BPE with the usual pattern whose merges are in the order of their ids is merging by rank: its ids are
    the same by the tiktoken library, several times faster. Files of any other kind are left to the tokenizers library.
    """

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.ranked = self.by_rank(spec)
        last = self.ranked.n_vocab if self.ranked else max(self.tokenizer.get_vocab().values())
        self.dtype = np.dtype("<u2" if last < 1 << 16 else "<u4")

    @cached_property
    def tokenizer(self) -> Tokenizer:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
        tokenizer = Tokenizer.from_file(self.path)
        tokenizer.encode_special_tokens = True
        return tokenizer

    @staticmethod
    def by_rank(spec: dict) -> tiktoken.Encoding | None:
        model, split = spec.get("model") or {}, spec.get("pre_tokenizer") or {}
        odd = ["dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"]
        usual = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        if model.get("type") != "BPE" or not usual or spec.get("normalizer") or spec.get("truncation") or spec.get("padding") or any(map(model.get, odd)):
            return None
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        ids = [model["vocab"].get(a + b) for a, b in merges]
        byte = byte_characters()
        special = {t["content"] for t in spec.get("added_tokens") or []}
        words = {t: i for t, i in model["vocab"].items() if t not in special}
        if None in ids or ids != sorted(set(ids)) or not all(c in byte for t in words for c in t) or len(words) != len(ids) + 256:
            return None
        return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks={bytes(map(byte.__getitem__, t)): i for t, i in words.items()}, special_tokens={})

    def encode(self, text: str) -> bytes:
        if not self.ranked or len(text) >= 20_000 and RUN.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()
        return b"".join([np.array(self.ranked.encode_ordinary(x), self.dtype).tobytes() for x in parts(text)])


def parts(text: str, most: int = PART) -> Iterator[str]:
    """A long text cut where a space follows and precedes other characters: the parts' ids in a row are the text's."""
    begin = 0
    while len(text) - begin > most and (cut := CUT.search(text, begin + most)):
        yield text[begin : cut.start()]
        begin = cut.start()
    yield text[begin:]


@lru_cache(2)
def load(path: str) -> Tokens:
    return Tokens(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def queued(docs: DataFrame, id_col: str, text_col: str, source_col: str, path: str | None, end: int) -> DataFrame:
    """(part, queue, before, id, source, n, ids) a document, as a table bucketed by part: its ids and the id `end`.

    part is the task that encoded it, queue the number of its source there, before the tokens of that source before it.
    """
    d = docs.select(col(id_col).alias("id"), col(source_col).alias("source"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))
    fields = [("part", T.LongType()), ("queue", T.IntegerType()), ("before", T.LongType()), ("id", d.schema["id"].dataType), ("source", d.schema["source"].dataType), ("n", T.LongType()), ("ids", T.BinaryType())]
    names = [n for n, _ in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = load(path or default_path())
        last, width = np.array([end], tokens.dtype).tobytes(), tokens.dtype.itemsize
        part, queues, sent = TaskContext.get().partitionId(), {}, []
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                rows = batch.slice(begin, 256)
                ids = [tokens.encode(text) + last for text in rows.column(2).to_pylist()]
                queue, before, n = [], [], [len(x) // width for x in ids]
                for source, size in zip(rows.column(1).to_pylist(), n, strict=True):
                    q = queues.setdefault(source, len(queues))
                    if q == len(sent):
                        sent.append(0)
                    queue.append(q)
                    before.append(sent[q])
                    sent[q] += size
                own = [pa.array([part] * len(ids), pa.int64()), pa.array(queue, pa.int32()), pa.array(before, pa.int64()), rows.column(0), rows.column(1)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(n, pa.int64()), pa.array(ids, pa.binary())], names=names)

    size = input_bytes(docs)
    buckets = max(2 * docs.sparkSession.sparkContext.defaultParallelism, -(-(size or 0) // (64 << 20)))
    return written(d.mapInArrow(run, T.StructType([T.StructField(n, t) for n, t in fields])), "part", buckets)


def placed(tokens: DataFrame, size: int) -> DataFrame:
    """(id, source, n, ids, at, lo, total, all): where in its queue a document begins; the tokens of the queues before
    its own, of its own, and of all. Only a row for each part and source moves.

    A source is a queue. Those with less than a token in a stretch of `size` share the first one, one after the other:
    so a queue's place never falls from one stretch to the next.
    """
    per = written(tokens.groupBy("part", "queue").agg(F.first("source").alias("source"), F.sum("n").alias("n")), small=True)
    every = Window.partitionBy(F.lit(1))  # a row a source
    sources = per.groupBy(F.col("source").alias("_source")).agg(F.sum("n").alias("own")).withColumn("all", F.sum("own").over(every))
    sources = sources.withColumn("common", F.expr(f"`all` div own < {size}"))
    sources = sources.withColumn("sum", F.sum("own").over(every.orderBy("common", F.col("_source").asc_nulls_last())) - F.col("own"))
    rare = F.sum(F.when(~F.col("common"), F.col("own"))).over(every)
    own = F.col("common")
    sources = sources.withColumn("lo", F.when(own, F.col("sum")).otherwise(0)).withColumn("total", F.when(own, F.col("own")).otherwise(rare))
    sources = sources.withColumn("first", F.when(own, 0).otherwise(F.col("sum")))
    parts = Window.partitionBy("source").orderBy("part")  # a row a part
    per = per.withColumn("off", F.sum("n").over(parts) - F.col("n")).join(sources, F.col("source").eqNullSafe(F.col("_source")))
    per = per.withColumn("off", F.col("off") + F.col("first"))
    places = per.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("queue", "off", "lo", "total", "all"))).alias("places"))
    d = tokens.join(places.hint("shuffle_hash"), "part").withColumn("place", F.get("places", F.col("queue")))
    return d.select("id", "source", "n", "ids", (F.col("place.off") + F.col("before")).alias("at"), "place.lo", "place.total", "place.all")


def due(tape: int, lo: int, total: int, all_: int) -> int:
    """How many tokens of a queue are on the tape's first `tape` tokens, at the beginning of a stretch."""
    return tape * (lo + total) // all_ - tape * lo // all_


def stretches(at: int, n: int, lo: int, total: int, all_: int, size: int) -> Iterator[tuple[int, int, int, int]]:
    """(stretch, the queue's place there, begin and end of what belongs to it) for the queue's tokens at to at + n."""
    k, begin = at * all_ // (total * size), at
    while k and due(min(all_, k * size), lo, total, all_) > at:
        k -= 1
    while begin < at + n:
        first, stop = due(min(all_, k * size), lo, total, all_), due(min(all_, (k + 1) * size), lo, total, all_)
        if begin < stop:
            yield k, begin - first, begin - at, min(stop, at + n) - at
            begin = min(stop, at + n)
        k += 1


def turns(k: int, size: int, window: int, grain: int, lo: int, total: int, all_: int) -> Iterator[tuple[int, int]]:
    """(round, tokens) that a queue sends in stretch k, by deficits in units of 1 / all_ tokens."""
    first, stop = min(all_, k * size), min(all_, (k + 1) * size)
    length, rounds = due(stop, lo, total, all_) - due(first, lo, total, all_), -(-(stop - first) // window)
    carried, quantum = first * total - due(first, lo, total, all_) * all_, window * total
    grain = grain if quantum < grain * all_ else 1
    sent, turn = 0, 0
    while sent < length:
        turn = max(turn + 1, -(-((sent + grain) * all_ - carried) // quantum))  # the round in which a grain is covered
        if turn >= rounds:
            turn, n = rounds, length - sent
        else:
            deficit = (carried + turn * quantum) // all_ - sent
            n = min(length - sent, deficit - deficit % grain)
        yield turn, n
        sent += n


def sequence_ends(length: int, window: int) -> list[int]:
    """Where sequences end on a tape: at each window; what is left is cut in powers of two, which need no padding."""
    ends, rest = list(range(window, length + 1, window)), length % window
    for bit in range(rest.bit_length() - 1, -1, -1):
        if rest >> bit & 1:
            ends.append((ends[-1] if ends else 0) + (1 << bit))
    return ends


def filled(k: int, rows: list[tuple[int, int, int, int]], all_: int, size: int, window: int, grain: int) -> list[tuple[int, int, int, int, int]]:
    """(row, begin, length, sequence, offset) a piece. rows: (lo, total, place, length), in order of lo and place."""
    queues: dict[int, list[int]] = {}
    for i, (lo, *_) in enumerate(rows):
        queues.setdefault(lo, []).append(i)
    plan = sorted((turn, lo, n) for lo, own in queues.items() for turn, n in turns(k, size, window, grain, lo, rows[own[0]][1], all_))
    ends = sequence_ends(min(all_, (k + 1) * size) - k * size, window)
    heads = {lo: iter(own) for lo, own in queues.items()}
    current: dict[int, tuple[int, int]] = {}
    at, s, start, out = 0, 0, 0, []
    for _, lo, n in plan:
        while n:
            row, begin = current.get(lo) or (next(heads[lo]), 0)
            if at == ends[s]:
                s, start = s + 1, at
            take = min(n, rows[row][3] - begin, ends[s] - at)
            if out and out[-1][0] == row and out[-1][3] == s and out[-1][1] + out[-1][2] == begin:
                out[-1] = (row, out[-1][1], out[-1][2] + take, s, out[-1][4])
            else:
                out.append((row, begin, take, s, at - start))
            current[lo] = (row, begin + take) if begin + take < rows[row][3] else None
            at, n = at + take, n - take
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", path: str | None = None, end: int = 0, window: int = 1024, grain: int = 64, stretch: int = 256) -> DataFrame:
    """(id, source, start, length, ids, doc_tokens, sequence_id, offset) a piece: ids (binary: little-endian unsigned
    32-bit integers) are the document's tokens from start on, and stand in the sequence from offset on.

    A document is its text's ids by a tokenizer file, without special tokens, and then the id `end`. Each of them lies in
    one piece. All sequences have `window` tokens but the corpus's last, which have powers of two. In each, a source has
    its share of all tokens to within two grains, or two tokens if its share is a grain or more. Documents are cut freely;
    larger grains make fewer cuts. stretch: windows that a task fills at a time; sources with less than a token in that
    many windows share a queue.

    Null and empty texts are the id `end` alone; null sources are a source of their own; null ids and repeated rows are
    documents like any other. An empty table gives no rows. Other columns are not read. Which documents meet depends on
    how the table is read in parts. Tasks open the tokenizer file themselves: by default that of their own
    public_tokenizers, else a path that every executor must have.
    """
    size = window * stretch
    d = placed(queued(docs, id_col, text_col, source_col, path, end), size)
    kinds = {f.name: f.dataType for f in d.schema.fields}
    numbers = ["stretch", "place", "start", "lo", "total", "all", "n"]
    cut = T.StructType([T.StructField("id", kinds["id"]), T.StructField("source", kinds["source"]), *[T.StructField(n, T.LongType()) for n in numbers], T.StructField("ids", T.BinaryType())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                some = batch.slice(i, 64)
                rows, numbers, ids = [], [], []
                places = zip(*[some.column(c).to_pylist() for c in ("n", "ids", "at", "lo", "total", "all")], strict=True)
                for row, (n, data, at, lo, total, all_) in enumerate(places):
                    width = len(data) // n
                    for k, place, begin, stop in stretches(at, n, lo, total, all_, size):
                        rows.append(row)
                        numbers.append((k, place, begin, lo, total, all_, n))
                        ids.append(data[begin * width : stop * width])
                which = pa.array(rows, pa.int32())
                own = [some.column(c).take(which) for c in ("id", "source")]
                own += [pa.array(x, pa.int64()) for x in zip(*numbers, strict=True)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(ids, pa.binary())], names=cut.names)

    tokens = {"path": path}
    result = [("id", kinds["id"]), ("source", kinds["source"]), ("start", T.LongType()), ("length", T.LongType()), ("ids", T.BinaryType()), ("doc_tokens", T.LongType()), ("sequence_id", T.LongType()), ("offset", T.LongType())]

    def fill(own: pa.Table) -> pa.Table:
        dtype = load(tokens["path"] or default_path()).dtype
        own = own.sort_by([("lo", "ascending"), ("place", "ascending")])
        ids = [np.frombuffer(x, dtype).astype("<u4") for x in own.column("ids").to_pylist()]
        lo, total, place, start, n = (own.column(c).to_pylist() for c in ("lo", "total", "place", "start", "n"))
        k, all_ = own.column("stretch")[0].as_py(), own.column("all")[0].as_py()
        pieces = filled(k, list(zip(lo, total, place, map(len, ids), strict=True)), all_, size, window, grain)
        row, begin, length, sequence, offset = (list(x) for x in zip(*pieces, strict=True))
        which = pa.array(row, pa.int64())
        columns = [
            own.column("id").take(which),
            own.column("source").take(which),
            pa.array([start[r] + b for r, b in zip(row, begin, strict=True)], pa.int64()),
            pa.array(length, pa.int64()),
            pa.array([ids[r][b : b + m].tobytes() for r, b, m, *_ in pieces], pa.binary()),
            pa.array([n[r] for r in row], pa.int64()),
            pa.array([k * stretch + s for s in sequence], pa.int64()),
            pa.array(offset, pa.int64()),
        ]
        return pa.Table.from_arrays(columns, names=[c for c, _ in result])

    return d.mapInArrow(deal, cut).groupBy("stretch").applyInArrow(fill, T.StructType([T.StructField(c, t) for c, t in result]))


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids, ends) from pack()'s pieces: a sequence's ids, and where its pieces end, for attention masks."""
    rows = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "length", "ids"))).alias("p"))
    joined = F.aggregate("p", F.lit(b""), lambda s, x: F.concat(s, x["ids"]))  # a window's pieces
    return rows.select("sequence_id", joined.alias("ids"), F.transform("p", lambda x: x["offset"] + x["length"]).alias("ends"))
