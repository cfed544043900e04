"""Language-model scoring by deleted interpolation of n-gram estimates.

P(w | h) = sum of l_k c(h_k w) / c(h_k) over the orders k, and l_0 / (V + 1): maximum-likelihood estimates of n-grams up
to an order (h_k are the k - 1 tokens before w; two is a bigram model), and a uniform floor that is also there for
unknown words. The weights l depend on the longest context that was seen and the bucket of its count, by powers of two,
and are learned by expectation-maximisation: a sixth of the training documents is deleted from the counts, and the
weights maximise the likelihood of its events under the counts of the rest. For that alone, estimates are rounded to
quarter powers of two (to whole ones above order two), so that events of all texts are a few thousand counts. The final
counts are those of all training documents. Counts are gathered and brought back by an exchange of chunks.

Words and n-grams are told apart by 63-bit hashes. That any two of n differ in count for want of bits has odds of about
n^2 / 2^64: 1 in 18 million for 10^6 distinct ones, nearly 1 in 2 for 3 * 10^9; beyond that a few of them share counts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scimap.llm.chunks import MIX, Chunk, Rule, answer_for, chunked, exchange, joined, mixed, opened, summed, sums_of

#: Buckets of context counts: 0, 1, 2-3, 4-7, ...
CONTEXTS = 40
#: Events are gathered by their estimates in steps of a power of two: four each up to order two, one beyond; 255: zero.
FINE, COARSE, NONE = 4, 1, 255
#: An event is a number of 8-bit digits: its state and an estimate for each order.
MOST_ORDER = 6
END = np.uint64(0x5EED)


def part_of(doc_id: int | None) -> int:
    """crc32 of the id as text, modulo 7; null: 2, never learned from."""
    return 2 if doc_id is None else zlib.crc32(str(doc_id).encode()) % 7


class Grams:
    """A chunk's tokens (words in lower case, then one end a text) and n-grams, by their places among its distinct keys.

    grams[k - 1] has the place of the k-gram that ends at each token, contexts[k - 2] that of the k - 1 tokens before it.
    A text begins after one end; -1 where a k-gram would begin before that.
    """

    def __init__(self, chunk: Chunk, order: int = 2):
        known: dict[bytes, int] = {b"": 0}
        flat, counts = [], []
        for text in chunk.texts():
            words = text.lower().split()
            counts.append(len(words) + 1)
            flat += [known.setdefault(w, len(known)) for w in words]
            flat.append(0)
        digest = np.array([END, *[xxhash.xxh64_intdigest(w) for w in list(known)[1:]]], np.uint64)
        self.counts = np.array(counts, np.int64)
        self.starts = np.cumsum(self.counts) - self.counts
        token = np.array(flat, np.int64)
        at = np.arange(len(token)) - np.repeat(self.starts, self.counts)
        # the lowest bit tells tokens (0) from longer n-grams (1)
        keys, gram = [mixed(digest) & ~np.uint64(1)], digest[token]
        for k in range(2, order + 1):
            before = np.roll(gram, 1)
            if k == 2:
                before[self.starts] = END
            gram = mixed(mixed(before * MIX) + digest[token])
            keys.append(gram[at >= k - 2] | np.uint64(1))
        self.keys, place = np.unique(np.concatenate(keys), return_inverse=True)
        one, *longer = np.split(place, np.cumsum([len(x) for x in keys])[:-1])
        self.grams, self.contexts = [one[token]], []
        for k, places in enumerate(longer, 2):
            context = np.roll(self.grams[-1], 1)
            context[at < max(1, k - 2)] = one[0] if k == 2 else -1
            self.contexts.append(context)
            self.grams.append(np.full(len(token), -1))
            self.grams[-1][at >= k - 2] = places
        ids = [None if k >= len(chunk.ids) - chunk.missing else i for k, i in enumerate(chunk.ids.tolist())]
        self.part = np.array([part_of(i) for i in ids], np.int64)

    def estimates(self, counts: np.ndarray, total: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """Each token's state (the longest context with a count, and that count's bucket; 0: none) and its estimates,
        the longest first, from the counts of keys and the tokens' total."""
        c = counts.astype(np.float64)
        state, out = np.zeros(len(self.grams[0]), np.int64), [c[self.grams[0]] / total]
        for k, (gram, context) in enumerate(zip(self.grams[1:], self.contexts)):
            of = np.where(context < 0, 0.0, c[context])
            out.append(np.divide(c[gram], of, out=np.zeros(len(of)), where=of > 0))
            state = np.where(of > 0, k * CONTEXTS + bucket_of(of), state)
        return state, out[::-1]


#: The part of the training documents that is deleted while weights are learned.
DELETED, HELD_OUT = 3, 2


def _send(chunk: Chunk, order: int = 2) -> tuple[np.ndarray, list[np.ndarray]]:
    """The chunk's keys with their counts in the training documents that aren't deleted and in those that are."""
    g = Grams(chunk, order)
    part = np.repeat(g.part, g.counts)
    out = []
    for take in ((part != DELETED) & (part != HELD_OUT), part == DELETED):
        out.append(np.bincount(np.concatenate([x[take & (x >= 0)] for x in g.grams]), minlength=len(g.keys)).astype(np.uint64))
    return g.keys, out


def _totals(merged: list[np.ndarray]) -> tuple[int, int, int]:
    """Tokens N, distinct tokens V and deleted tokens."""
    keys, rest, gone = merged
    tokens = (keys & np.uint64(1)) == 0
    total = (rest + gone)[tokens]
    return int(total.sum()), int((total > 0).sum()), int(gone[tokens].sum())


#: Chunks get the counts in the rest and in the deleted part of the training documents.
COUNTS = Rule(summed, lambda merged, own: merged, _totals, 2)


def bucket_of(count: np.ndarray) -> np.ndarray:
    """0 for 0, else 1 + the power of two below."""
    return np.minimum(np.frexp(count.astype(np.float64))[1], CONTEXTS - 1)


def _step(p: np.ndarray, steps: int) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.minimum(np.rint(-np.log2(p) * steps), NONE - 1), NONE).astype(np.int64)


def learn(events: list[tuple[int, ...]], v: int, order: int = 2, rounds: int = 500, change: float = 1e-6) -> np.ndarray:
    """The weights (orders downwards, uniform) for each state, from events (state, steps of the estimates downwards, n).

    Rounds go on until no weight changes by more than `change`. All events together start from equal weights, each
    state from theirs. 10 events of the weights of all events together are added to each, so that
    states with few events have reasonable weights; no weight of the uniform floor is below 1e-6.
    """
    e = np.array(events, np.int64).reshape(-1, order + 2)
    steps = FINE if order <= 2 else COARSE
    p = np.where(e[:, 1:-1] == NONE, 0.0, 2.0 ** (-e[:, 1:-1] / steps))
    p = np.concatenate([p, np.full((len(e), 1), 1 / (v + 1))], axis=1)
    n = e[:, -1].astype(np.float64)

    def run(state: np.ndarray, size: int, prior: np.ndarray) -> np.ndarray:
        w = np.tile(prior, (size, 1))
        for _ in range(rounds):
            share = w[state] * p
            share *= (n / share.sum(axis=1))[:, None]
            new = np.stack([np.bincount(state, share[:, k], size) for k in range(order + 1)], axis=1) + 10 * prior
            new /= new.sum(axis=1, keepdims=True)
            w, moved = new, float(np.abs(new - w).max())
            if moved <= change:
                break
        return w

    alike = run(np.zeros(len(e), np.int64), 1, np.full(order + 1, 1 / (order + 1)))[0]
    w = run(e[:, 0], CONTEXTS * max(1, order - 1), alike)
    for state in range(len(w)):  # longer contexts than the longest seen have no estimates
        unseen = order - (state // CONTEXTS + 2 if state else 1)
        if unseen > 0:
            w[state, unseen] += w[state, :unseen].sum()
            w[state, :unseen] = 0
    w[:, -1] = np.maximum(w[:, -1], 1e-6)
    return w / w.sum(axis=1, keepdims=True)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 2, **sizes) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs.

    Tokens are words in lower case (A-Z), then one end. Learning takes the documents whose crc32(id as text) modulo 7
    is not 2. n_known counts tokens seen in training; base_score is the log10 probability by add-one unigrams, score
    that by the model of n-grams up to `order` (1 to 6). Null and empty texts have the one token end; null ids are held out; rows with one id are
    documents of their own. Without training documents, every score is 0 = log10 1. An empty table gives no rows.
    """
    if not 1 <= order <= MOST_ORDER:
        raise ValueError(f"order must be 1 to {MOST_ORDER}")
    chunks = chunked(docs, id_col, text_col, **sizes)
    ranges = chunks.ranges
    counts = exchange(chunks, [], partial(_send, order=order), COUNTS)
    n, v, deleted = (int(x) for x in sums_of(counts, 3))
    rows = joined(chunks, [counts])
    remaining = max(1, n - deleted)

    names = ["state", *[f"s{k}" for k in range(order, 0, -1)]]

    def deleted_events(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, chunk, (answer,) in opened(batches):
            g = Grams(chunk, order)
            rest, _ = answer_for(g.keys, answer, ranges)
            take = np.repeat(g.part == DELETED, g.counts)
            key, found = g.estimates(rest, remaining)
            for p in found:
                key = key * 256 + _step(p, FINE if order <= 2 else COARSE)
            key, k = np.unique(key[take], return_counts=True)
            digits = [key >> 8 * j & 255 for j in range(order, -1, -1)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (*digits, k)], names=[*names, "n"])

    events = rows.mapInArrow(deleted_events, ", ".join(f"{x} bigint" for x in [*names, "n"])).groupBy(*names).agg(F.sum("n").alias("n"))
    weights = learn([tuple(r) for r in events.collect()], v, order)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, chunk, (answer,) in opened(batches):
            g = Grams(chunk, order)
            rest, gone = answer_for(g.keys, answer, ranges)
            own = (rest + gone).astype(np.float64)[g.grams[0]]
            state, found = g.estimates(rest + gone, max(1, n))
            w = weights[state]
            p = sum(w[:, j] * x for j, x in enumerate(found)) + w[:, -1] / (v + 1) if n else np.ones(len(own))
            sums = [np.add.reduceat(x, g.starts) for x in (own > 0, np.log10((own + 1) / (n + v + 1)), np.log10(p))]
            size = len(g.counts)
            cols = [chunk.id_array(), pa.array(g.part == HELD_OUT), pa.array(g.counts), pa.array(sums[0].astype(np.int64)), pa.array([n] * size, pa.int64()), pa.array(sums[1]), pa.array(sums[2])]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = "id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return rows.mapInArrow(scored, schema)
