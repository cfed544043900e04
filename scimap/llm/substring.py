"""Substring deduplication by difference-cover anchors.

Anchors are hashes of SPAN words at the positions of a document that are in COVER modulo PERIOD. The differences of
COVER give every residue, so for any two positions there is a shift below PERIOD that takes both to positions in the
cover: two equal windows of WINDOW words, wherever they begin, share an anchor at the same place within them. So only
windows about an anchor that stands in several documents can be repeated; only those are hashed whole, and looked up
for the smallest document that has them. Matches longer than a window are unions of windows: each is extended over all
the words that its windows cover. Both look-ups are exchanges of chunks, without a pair of documents ever formed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from scimap.llm.chunks import MIX, Chunk, Rule, answer_for, chunked, exchange, joined, mixed, opened, summed, window_hashes

WINDOW, PERIOD, COVER = 13, 7, (0, 1, 3)
SPAN = WINDOW - PERIOD + 1


class Words:
    """A chunk's words as hashes, in a row, with where each document's begin."""

    def __init__(self, chunk: Chunk):
        known: dict[bytes, int] = {}
        flat, counts = [], []
        for text in chunk.texts():
            words = text.split()
            counts.append(len(words))
            flat += [known.setdefault(w, len(known)) for w in words]
        digest = np.array([xxhash.xxh64_intdigest(w) for w in known], np.uint64)
        self.counts = np.array(counts, np.int64)
        self.starts = np.cumsum(self.counts) - self.counts
        self.hashes = digest[np.array(flat, np.int64)] if flat else np.zeros(0, np.uint64)
        self.doc = np.repeat(np.arange(len(counts)), self.counts)
        self.place = np.arange(len(flat)) - self.starts[self.doc]
        self.left = self.counts[self.doc] - self.place  # words from here to the document's end

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Where anchors begin, and their hashes."""
        at = np.flatnonzero(np.isin(self.place % PERIOD, COVER) & (self.left >= SPAN))
        return at, window_hashes(self.hashes, SPAN)[at]

    def windows(self, shared: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where windows about a shared anchor begin, and two hashes of each."""
        mark = np.zeros(len(self.hashes) + PERIOD, np.int64)
        mark[at[shared]] = 1
        total = np.concatenate([[0], np.cumsum(mark)])
        near = total[PERIOD : PERIOD + len(self.hashes)] > total[: len(self.hashes)]
        begin = np.flatnonzero(near & (self.left >= WINDOW))
        if not len(begin):
            return begin, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        take = begin[:, None] + np.arange(WINDOW)
        two = []
        for salt in (1, 2):
            h = np.full(len(begin), np.uint64(salt), np.uint64)
            for k in range(WINDOW):
                h = _step(h, self.hashes[take[:, k]])
            two.append(h)
        return begin, two[0], two[1]


def _step(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    return mixed(h * MIX + x)


def _send_anchors(chunk: Chunk) -> tuple[np.ndarray, list[np.ndarray]]:
    """A chunk's distinct anchors; 1 for those in one of its documents, 2 for those in several."""
    w = Words(chunk)
    at, hashes = w.anchors()
    if not len(at):
        return hashes, [np.zeros(0, np.uint64)]
    doc = chunk.ids[w.doc[at]]
    order = np.lexsort((doc, hashes))
    hashes, doc = hashes[order], doc[order]
    first = np.append(True, hashes[1:] != hashes[:-1])
    more = np.append(False, (hashes[1:] == hashes[:-1]) & (doc[1:] != doc[:-1]))
    begin = np.flatnonzero(first)
    return hashes[begin], [(np.add.reduceat(more.astype(np.int64), begin) > 0).astype(np.uint64) + np.uint64(1)]


def _merge_anchors(parts: list) -> tuple[list[np.ndarray], np.ndarray]:
    """An anchor of several parts, or in several documents of one, has 2."""
    (keys, total), back = summed(parts)
    return [keys, np.minimum(total, np.uint64(2))], back


#: Chunks get 1 for the anchors that are in several documents.
ANCHORS = Rule(_merge_anchors, lambda merged, own: [merged[0] > 1], lambda merged: (len(merged[0]),))


def _shared(w: Words, answer: list, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """Where anchors begin, and which of them stand in several documents."""
    at, hashes = w.anchors()
    if not len(at):
        return at, np.zeros(0, bool)
    keys, back = np.unique(hashes, return_inverse=True)
    return at, answer_for(keys, answer, ranges)[0][back].astype(bool)


def _distinct(a: np.ndarray, b: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (a, b), sorted, with the smallest doc of each, and each row's place among them."""
    order = np.lexsort((doc, b, a))
    x, y = a[order], b[order]
    first = np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])) if len(x) else np.zeros(0, bool)
    back = np.empty(len(a), np.int64)
    back[order] = np.cumsum(first) - 1
    return x[first], y[first], doc[order][first], back


#: Ids are sent as unsigned integers in the same order.
OFFSET = np.uint64(1 << 63)


def _merge_windows(parts: list) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct windows (two hashes) with the smallest document that has each."""
    *merged, back = _distinct(*[np.concatenate([p[k] for p in parts]) for k in range(3)])
    return merged, back


#: Chunks get 1 for the windows that a smaller document has than their smallest.
WINDOWS = Rule(_merge_windows, lambda merged, own: [merged[1] < own[1]], lambda merged: (len(merged[0]),), 2)


def _candidates(chunk: Chunk, w: Words, answer: list, ranges: int):
    at, shared = _shared(w, answer, ranges)
    begin, a, b = w.windows(shared, at)
    doc = chunk.ids[w.doc[begin]].view(np.uint64) ^ OFFSET
    return begin, doc, _distinct(a, b, doc)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **sizes) -> DataFrame:
    """(id, n_words, n_removed, spans, kept_text) for each row of docs.

    A word goes if a window of WINDOW words of its document covers it whose words also begin in a document with a
    smaller id, judged on the input. spans: the removed runs of words as a flat list begin, end (excluded), ...;
    kept_text: the words that stay, joined by one space. Ids are integers; a null id is larger than all others. Rows
    with one id are one document: they never make each other's words go. Null, empty and short texts lose nothing. An
    empty table gives no rows. sizes: as for chunked().
    """
    chunks = chunked(docs, id_col, text_col, **sizes)
    ranges = chunks.ranges
    first = exchange(chunks, [], _send_anchors, ANCHORS)

    def send_windows(chunk: Chunk, answer: list):
        _, _, (a, b, least, _) = _candidates(chunk, Words(chunk), answer, ranges)
        return a, [b, least]

    second = exchange(chunks, [first], send_windows, WINDOWS)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, chunk, (one, two) in opened(batches):
            w = Words(chunk)
            begin, doc, (a, _, least, back) = _candidates(chunk, w, one, ranges)
            gone = np.zeros(len(w.hashes), bool)
            if len(begin):
                earlier = answer_for(a, two, ranges)[0].astype(bool)
                hit = begin[earlier[back] | (doc > least[back])]
                edge = np.zeros(len(w.hashes) + 1, np.int64)
                np.add.at(edge, hit, 1)
                np.add.at(edge, hit + WINDOW, -1)
                gone = np.cumsum(edge)[:-1] > 0
            removed, spans, kept = [], [], []
            for text, begin_, n in zip(chunk.texts(), w.starts.tolist(), w.counts.tolist(), strict=True):
                mask = gone[begin_ : begin_ + n]
                words = text.split()
                removed.append(int(mask.sum()))
                if removed[-1]:
                    change = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
                    spans.append(change.tolist())
                    words = [x for x, g in zip(words, mask.tolist(), strict=True) if not g]
                else:
                    spans.append([])
                kept.append(b" ".join(words).decode())
            cols = [chunk.id_array(), pa.array(w.counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "n_words", "n_removed", "spans", "kept_text"])

    return joined(chunks, [first, second]).mapInArrow(judge, "id bigint, n_words bigint, n_removed bigint, spans array<bigint>, kept_text string")
