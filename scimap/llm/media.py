"""Media columns: content-addressed payloads in tar shards, rows with digest, shard, offset and length.

A payload (here a document's UTF-8 bytes, padded) becomes a grey PNG of 64 columns, one 8-bit sample a byte, losslessly
compressed. Each task appends its images to tar files of its own in the shared folder; a member is named by the SHA-256
of its payload and is stored once in a shard. Files are named by attempt, so one of a task that was lost is never read.
Reading goes by (shard, offset, length): header-only range reads fill metadata columns, whole reads give the payload.
Of equal payloads in several shards, one place is chosen for all rows. Payloads never pass a shuffle.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scimap.llm.common import col, written
from scimap.sources.stores import scratch

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Bytes from a PNG's start to the end of its IHDR chunk.
HEADER = 33


def pad(data: bytes) -> bytes:
    """data with bytes 0 appended up to a positive multiple of WIDTH."""
    return data + bytes((-len(data)) % WIDTH or (0 if data else WIDTH))


def to_png(payload: bytes) -> bytes:
    """A grey 8-bit PNG of WIDTH columns whose samples are the payload."""
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 3)) + chunk(b"IEND", b"")


def png_header(data: bytes) -> dict:
    """Width, height, bit depth and colour type from a PNG's first HEADER bytes."""
    if data[:8] != SIGNATURE or data[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    return dict(zip(("width", "height", "bit_depth", "color_type"), struct.unpack(">IIBB", data[16:26]), strict=True))


def from_png(data: bytes) -> bytes:
    """The samples of a PNG as to_png writes it."""
    at, body = 8, []
    while at < len(data):
        (size,) = struct.unpack(">I", data[at : at + 4])
        if data[at + 4 : at + 8] == b"IDAT":
            body.append(data[at + 8 : at + 8 + size])
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(-1, WIDTH + 1)
    if rows[:, 0].any():
        raise ValueError("rows with filters")
    return rows[:, 1:].tobytes()


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = 256 << 20) -> DataFrame:
    """Write every text's payload; the rows (id, n_bytes, digest, shard, offset, length) of docs, one for each.

    Null and empty texts have a payload of 64 bytes 0. Repeated texts share a digest. Null ids stay null. An empty
    table writes no shard and gives no rows.
    """
    spark = docs.sparkSession
    folder = scratch(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        out, at, places, shard = None, 0, {}, ""
        try:
            for batch in batches:
                rows: list[tuple] = []
                for text in batch.column(1).to_pylist():
                    data = (text or "").encode()
                    payload = pad(data)
                    digest = hashlib.sha256(payload).hexdigest()
                    if out is not None and at >= shard_bytes:
                        out.close()
                        out = None
                    if out is None:
                        shard, at, places = f"{uuid.uuid4().hex}.tar", 0, {}
                        out = files.open_output_stream(f"{base}/{shard}")
                    if digest not in places:
                        image = to_png(payload)
                        info = tarfile.TarInfo(f"{digest}.png")
                        info.size = len(image)
                        member = info.tobuf(tarfile.USTAR_FORMAT) + image + bytes(-len(image) % 512)
                        places[digest] = (at + 512, len(image))
                        out.write(member)
                        at += len(member)
                    rows.append((len(data), digest, shard, *places[digest]))
                cols = list(zip(*rows, strict=True)) or [()] * 5
                kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
                arrays = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["id", "n_bytes", "digest", "shard", "offset", "length"])
        finally:
            if out is not None:
                out.write(bytes(1024))
                out.close()

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(col(id_col).alias("id"), col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_bytes bigint, digest string, shard string, offset bigint, length bigint")
    return written(rows.withColumn("shard", F.concat(F.lit(folder + "/"), "shard")))


def places(rows: DataFrame) -> DataFrame:
    """One place for each digest: (digest, shard, offset, length)."""
    p = rows.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("p"))
    return p.select("digest", "p.shard", "p.offset", "p.length")


def _ranges(where: DataFrame, schema: str, read) -> DataFrame:
    """where's digests with what read(file, offset, length) gives, in the order of the shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        for batch in batches:
            out = []
            for digest, shard, offset, length in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if shard != name:
                    if file is not None:
                        file.close()
                    files, path = fs.FileSystem.from_uri(shard)
                    name, file = shard, files.open_input_file(path)
                out.append((digest, *read(file, offset, length)))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=[x.split()[0] for x in ("digest string, " + schema).split(", ")])
        if file is not None:
            file.close()

    n = int(where.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return where.repartitionByRange(n, "shard", "offset").sortWithinPartitions("shard", "offset").mapInArrow(run, f"digest string, {schema}")


def metadata(where: DataFrame) -> DataFrame:
    """(digest, width, height, bit_depth, color_type), from header-only range reads of HEADER bytes."""
    return _ranges(
        where.select("digest", "shard", "offset", "length"),
        "width bigint, height bigint, bit_depth bigint, color_type bigint",
        lambda file, offset, length: tuple(png_header(file.read_at(min(HEADER, length), offset)).values()),
    )


def _features(file, offset: int, length: int) -> tuple:
    image = file.read_at(length, offset)
    payload = from_png(image)
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    share = counts[counts > 0] / len(payload)
    values = np.arange(256)
    mean = float((counts * values).sum() / len(payload))
    sd = float(np.sqrt((counts * (values - mean) ** 2).sum() / len(payload)))
    entropy = float(-(share * np.log2(share)).sum())
    feature = f"mean={mean:.3f};sd={sd:.3f};entropy={entropy:.3f};distinct={len(share)}"
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(image), hashlib.sha256(image).hexdigest(), feature


def read_back(where: DataFrame) -> DataFrame:
    """The payloads' sizes, digests and features, from the stored bytes."""
    schema = "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return _ranges(where.select("digest", "shard", "offset", "length"), schema, _features)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """store(), then metadata() and read_back() of one place a digest, joined to all rows: a row for each of docs.

    Null and empty texts have a payload of 64 bytes 0; null ids stay null, repeated rows stay; an empty table gives no
    rows. Other columns are not read.
    """
    rows = store(docs, id_col, text_col)
    where = written(places(rows))
    return rows.select("id", "n_bytes", "digest").join(where, "digest").join(metadata(where), "digest").join(read_back(where), "digest")
