"""Byte-level BPE by monoid tree reduction.

The encodings of byte strings are a monoid: two neighbours are joined by encoding anew a window about their boundary,
and widening it until it fits. It fits when every pair of adjacent tokens on its edges is the encoding of the pair's
own bytes; a sequence whose adjacent pairs all have that property is the encoding of the whole, so no token outside the
window can change. A match of the split pattern is encoded by halves, recursively, down to a few bytes; matches never
merge with each other, so a text's encoding is theirs in a row. Decoding concatenates up the same kind of tree.
"""

from __future__ import annotations

import base64
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from scimap.llm.arrow import with_text_columns
from scimap.llm.common import fresh

#: Strings of at most so many bytes are merged directly.
LEAF = 5
#: The tables of known encodings are emptied beyond so many entries.
KNOWN = 300_000


class Bpe:
    """Encoder and decoder for one table of ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.parts: dict[bytes, tuple[int, ...]] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.known = _Known(self)

    def merge(self, data: bytes) -> tuple[int, ...]:
        """The encoding of data by merging the lowest-ranked adjacent pair, leftmost first, again and again."""
        ranks = self.ranks
        if len(data) > 48:
            return self._merge_long(data)
        if (whole := ranks.get(data)) is not None:
            return (whole,)
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, 0
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return tuple([ranks[p] for p in parts])

    def _merge_long(self, data: bytes) -> tuple[int, ...]:
        """merge() with a heap of pairs and a linked list of parts."""
        ranks, n = self.ranks, len(data)
        end, after, before, gone = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1)), [False] * n
        heap = []

        def push(i: int) -> None:
            if i >= 0 and (j := after[i]) < n and (r := ranks.get(data[i : end[j]])) is not None:
                heapq.heappush(heap, (r, i, end[j]))

        for i in range(n - 1):
            push(i)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if gone[i] or (j := after[i]) >= n or end[j] != stop:
                continue
            end[i], after[i], gone[j] = end[j], after[j], True
            if after[i] < n:
                before[after[i]] = i
            push(before[i])
            push(i)
        return tuple([ranks[data[i : end[i]]] for i in range(n) if not gone[i]])

    def fit(self, a: int, b: int) -> bool:
        """Whether tokens a and b in a row are the encoding of their bytes."""
        if (x := self.fits.get((a, b))) is None:
            if len(self.fits) > KNOWN:
                self.fits.clear()
            x = self.fits[a, b] = self.merge(self.bytes_of[a] + self.bytes_of[b]) == (a, b)
        return x

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """The encoding of the bytes of left and right together."""
        if not left or not right:
            return left or right
        if self.fit(left[-1], right[0]):
            return left + right
        i, j = 1, 1
        while True:
            window = self.merge(b"".join([self.bytes_of[t] for t in left[-i:] + right[:j]]))
            good_left = i == len(left) or self.fit(left[-i - 1], window[0])
            good_right = j == len(right) or self.fit(window[-1], right[j])
            if good_left and good_right:
                return left[: len(left) - i] + window + right[j:]
            i, j = i if good_left else min(len(left), 2 * i), j if good_right else min(len(right), 2 * j)

    def encode_bytes(self, data: bytes) -> tuple[int, ...]:
        """The encoding of one match of the pattern: of its halves, joined."""
        if (whole := self.ranks.get(data)) is not None:
            return (whole,)
        if (out := self.parts.get(data)) is None:
            if len(data) <= LEAF:
                out = self.merge(data)
            else:
                half = len(data) // 2
                out = self.join(self.encode_bytes(data[:half]), self.encode_bytes(data[half:]))
            if len(data) <= 24:
                if len(self.parts) > KNOWN:
                    self.parts.clear()
                self.parts[data] = out
        return out

    def encode(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit integers."""
        known = self.known
        if len(known) > KNOWN:
            known.clear()
        if len(text) < 1 << 20:
            return b"".join(map(known.__getitem__, self.pattern.findall(text)))
        return b"".join(known[m[0]] for m in self.pattern.finditer(text))

    def decode(self, ids: bytes) -> bytes:
        """The bytes of the ids, concatenated by halves."""
        level, of = np.frombuffer(ids, "<u4").tolist(), self.bytes_of
        level = [b"".join([of[t] for t in level[i : i + 512]]) for i in range(0, len(level), 512)]
        while len(level) > 1:
            level = [b"".join(level[i : i + 2]) for i in range(0, len(level), 2)]
        return level[0] if level else b""


class _Known(dict):
    """Match -> its packed ids, made at need."""

    def __init__(self, bpe: Bpe):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, match: str) -> bytes:
        out = np.array(self.bpe.encode_bytes(match.encode()), "<u4").tobytes()
        if len(match) <= 40:
            self[match] = out
        return out


@lru_cache(2)
def load(path: str, pattern: str) -> Bpe:
    """The table of a .tiktoken file: a line for each token, base64 and rank."""
    with open(path, "rb") as f:
        return Bpe({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}, pattern)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def encode(docs: DataFrame, text_col: str = "text", path: str | None = None, pattern: str | None = None, drop_text: bool = False) -> DataFrame:
    """docs with n_tokens (long) and ids (binary: little-endian unsigned 32-bit integers).

    Each match of pattern is encoded by itself, without special tokens. Null and empty texts have no ids (0, empty
    binary). All rows and columns stay, repeated rows too; the new columns get underscores added if docs has such
    columns. An empty table stays empty. Tasks open the ranks' file themselves: by default that of their own
    public_tokenizers, else a path that every executor must have.
    """
    n, ids = fresh(docs, "n_tokens", "ids")

    def make():
        bpe = load(path or default_path(), pattern or default_pattern())

        def of(texts: list[str]) -> list[pa.Array]:
            out = [bpe.encode(t) for t in texts]
            return [pa.array([len(x) // 4 for x in out], pa.int64()), pa.array(out, pa.binary())]

        return of

    return with_text_columns(docs, text_col, [T.StructField(n, T.LongType()), T.StructField(ids, T.BinaryType())], make, drop_text)


def round_trip(docs: DataFrame, text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """decode(encode(docs)) without the text, in one Python worker a task: docs with n_tokens, ids and decoded."""
    names = fresh(docs, "n_tokens", "ids", "decoded")

    def make():
        bpe = load(path or default_path(), pattern or default_pattern())

        def of(texts: list[str]) -> list[pa.Array]:
            ids = [bpe.encode(t) for t in texts]
            return [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([bpe.decode(x) for x in ids], pa.binary())]

        return of

    kinds = (T.LongType(), T.BinaryType(), T.BinaryType())
    return with_text_columns(docs, text_col, [T.StructField(n, k) for n, k in zip(names, kinds, strict=True)], make, drop=True)


def decode(encoded: DataFrame, ids_col: str = "ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """encoded with decoded (binary): the bytes of the ids. Null ids give empty bytes; all rows and columns stay."""
    (name,) = fresh(encoded, "decoded")

    def make():
        bpe = load(path or default_path(), pattern or default_pattern())
        return lambda ids: [pa.array([bpe.decode(x) if x else b"" for x in ids], pa.binary())]

    return with_text_columns(encoded, ids_col, [T.StructField(name, T.BinaryType())], make)
