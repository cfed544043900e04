"""Vector code compression: product codes with integer codebooks.

Vectors become integers, cut into equal consecutive parts; each part is replaced by the number of the nearest entry of
its position's codebook. Vectors are laid out once in blocks, a row of a table each: one component of all of a block's
vectors after the other. Distances to all entries accumulate component by component over a block. In training, every
task adds the parts nearest to each entry into int64 tensors of sums and counts, which merge through a reduction tree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scimap.llm.common import col, fits, with_group_sum, written

#: Vectors in a block.
BLOCK = 4096


class Codebooks(NamedTuple):
    """entries: int64, parts x entries x width, in the order of the codes; scale: what components were multiplied by."""

    entries: np.ndarray
    scale: int

    def sha256(self) -> str:
        """Of all components in decimal, by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def usual_length(vectors: DataFrame, vector: Column, parts: int) -> int:
    """The length that most vectors have, of those that can be cut into equal parts; of equals, the greater; `parts` if there is none."""
    sizes = vectors.where(fits(vector)).groupBy(F.size(vector).alias("n")).count().where((F.col("n") > 0) & (F.col("n") % parts == 0))
    row = sizes.orderBy(F.col("count").desc(), F.col("n").desc()).first()
    return row.n if row else parts


def blocks_of(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, length: int, scale: int, block: int) -> DataFrame:
    """(ids, labels, components) a block; components: int32, little-endian, by component and then by vector."""
    kept = vectors.where(fits(col(vector_col)) & (F.size(col(vector_col)) == length))
    kept = kept.select(col(id_col).alias("id"), col(label_col).alias("label"), col(vector_col).alias("v"))
    kinds = [T.StructField("ids", T.ArrayType(kept.schema["id"].dataType)), T.StructField("labels", T.ArrayType(kept.schema["label"].dataType))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, block):
                part = batch.slice(begin, block)
                x = part.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, length)
                x = np.floor(x * scale)
                if np.abs(x).max() >= 1 << 29:
                    raise ValueError(f"components of 2**29 / {scale} and more have no exact distances in 64 bits")
                rows = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(i)) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*rows, pa.array([x.T.astype("<i4").tobytes()], pa.binary())], names=["ids", "labels", "components"])

    return written(kept.mapInArrow(run, T.StructType([*kinds, T.StructField("components", T.BinaryType())])))


def nearest(block: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For a block (length x n): the nearest entry of each part, the lower of equals, and its squared distance (parts x n)."""
    parts, k, width = entries.shape
    codes, errors = np.empty((parts, block.shape[1]), np.int64), np.empty((parts, block.shape[1]), np.int64)
    for p in range(parts):
        distance = np.zeros((block.shape[1], k), np.int64)
        for d in range(width):
            off = block[p * width + d][:, None] - entries[p, :, d]
            distance += off * off
        codes[p] = distance.argmin(1)
        errors[p] = distance[np.arange(len(distance)), codes[p]]
    return codes, errors


def _add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a + b, in Python's integers where 64 bits might not hold it."""
    if a.dtype == object or b.dtype == object or max(abs(int(x)) for y in (a, b) for x in (y.min(), y.max())) >= 1 << 62:
        return a.astype(object) + b.astype(object)
    return a + b


def improved(blocks: DataFrame, entries: np.ndarray, depth: int = 2) -> np.ndarray:
    """entries after a round: each the floor of the mean of the parts nearest to it; unused ones stay."""
    parts, k, width = entries.shape
    length = parts * width

    def take(known: tuple | None, row: Row) -> tuple:
        sums, counts = known or (np.zeros((parts, k, width), np.int64), np.zeros((parts, k), np.int64))
        block = np.frombuffer(row.components, "<i4").reshape(length, -1).astype(np.int64)
        for p, code in enumerate(nearest(block, entries)[0]):
            np.add.at(sums[p], code, block[p * width : (p + 1) * width].T)
            np.add.at(counts[p], code, 1)
        return sums, counts

    def merge(a: tuple | None, b: tuple | None) -> tuple | None:
        return (_add(a[0], b[0]), a[1] + b[1]) if a and b else a or b

    found = blocks.select("components").rdd.treeAggregate(None, take, merge, depth)
    if found is None:
        return entries
    sums, counts = found
    return np.where(counts[..., None] > 0, sums // np.maximum(counts, 1)[..., None], entries).astype(np.int64)


def train(vectors: DataFrame, blocks: DataFrame, id_col: str, vector_col: str, length: int, parts: int, entries: int, rounds: int, scale: int) -> Codebooks:
    """Codebooks that begin as the parts of the vectors with the smallest ids (equal ids by components, null ids last)."""
    kept = vectors.where(fits(col(vector_col)) & (F.size(col(vector_col)) == length)).select(col(id_col).alias("id"), col(vector_col).alias("v"))
    first = kept.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()  # `entries` rows
    books = np.floor(np.array([r.v for r in first], np.float64).reshape(len(first), parts, length // parts) * scale).astype(np.int64).transpose(1, 0, 2)
    for _ in range(rounds):
        books = improved(blocks, books)
    return Codebooks(books, scale)


def encoded(blocks: DataFrame, books: Codebooks) -> DataFrame:
    """(id, label, code, error) a vector of the blocks."""
    parts, _, width = books.entries.shape
    kinds = [T.StructField(n, blocks.schema[c].dataType.elementType) for n, c in (("id", "ids"), ("label", "labels"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                block = np.frombuffer(row.column(2)[0].as_py(), "<i4").reshape(parts * width, -1).astype(np.int64)
                codes, errors = nearest(block, books.entries)
                text = codes.T.astype(np.uint8).tobytes().hex()
                code = pa.array([text[at : at + 2 * parts] for at in range(0, len(text), 2 * parts)], pa.string())
                yield pa.RecordBatch.from_arrays([row.column(0).flatten(), row.column(1).flatten(), code, pa.array(errors.sum(0))], names=["id", "label", "code", "error"])

    return blocks.mapInArrow(run, T.StructType([*kinds, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())]))


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", length: int | None = None, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, block: int = BLOCK) -> tuple[DataFrame, Codebooks]:
    """(id, label, code, error, label_error) a vector, and the codebooks.

    code has two hexadecimal digits a part. error is the squared distance between a vector's integers, floor(scale * x),
    and its entries; label_error is its sum over equal labels, null being a label like any other.

    Vectors that are null, or hold null or non-finite components, are dropped; so are those of another length than
    `length` (by default that of most vectors that can be cut into `parts` equal parts), for they have no place in the
    codebooks. Null ids, repeated rows and equal vectors are vectors like any other; fewer vectors than `entries` give
    smaller codebooks. An empty table gives no rows and empty codebooks. Components of 2**29 / scale or more are refused
    with an error, since their distances don't fit the result. Other columns are not read. Distances, sums and means
    are exact. To the driver come `entries` vectors once, and a tensor of the codebooks' size a round.
    """
    if not 0 < entries <= 256:
        raise ValueError("codes of two hexadecimal digits have 1 to 256 entries")
    length = usual_length(vectors, col(vector_col), parts) if length is None else length
    if length < 1 or length % parts:
        raise ValueError(f"{length} components can't be cut into {parts} equal parts")
    blocks = blocks_of(vectors, id_col, vector_col, label_col, length, scale, block)
    books = train(vectors, blocks, id_col, vector_col, length, parts, entries, rounds, scale)
    return with_group_sum(written(encoded(blocks, books)), "label", "error", "label_error"), books
