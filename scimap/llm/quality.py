"""Quality classifier: regularised quadratic discriminant analysis of document statistics.

Each class has a mean and a covariance of its own, shrunk towards the pooled covariance and the diagonal. A score is
the logistic of the difference of the classes' Mahalanobis log densities and log priors; the Cholesky factors are
computed once, with the model.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scimap.llm.arrow import with_text_columns
from scimap.llm.common import col, fresh, written

#: Kinds of bytes: 0 other letters (all of UTF-8 beyond ASCII), 1 a-z, 2 A-Z, 3 digits, 4 white space, 5 sentence marks, 6 other symbols.
KIND = np.zeros(256, np.uint8)
KIND[:128] = 6
KIND[ord("a") : ord("z") + 1], KIND[ord("A") : ord("Z") + 1], KIND[ord("0") : ord("9") + 1] = 1, 2, 3
KIND[list(b" \t\n\x0b\x0c\r")], KIND[list(b".,;:'\"()-")] = 4, 5

#: Length; mean length of words; shares of the kinds of bytes; how words repeat; how lines are made.
FEATURES = ("log_bytes", "word_length", "upper", "digit", "mark", "symbol", "new_word", "top_word", "same_next", "line_words", "line_end")
#: Labelled documents that a model is learned from at most.
EXAMPLES = 100_000


def statistics(text: str) -> list[float]:
    """The transformed statistics of a text; all 0 for one without words."""
    data = text.encode()
    words = data.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, lines = len(words), [x for x in text.split("\n") if x.strip()]
    kinds = np.bincount(KIND[np.frombuffer(data, np.uint8)], minlength=7).tolist()
    black = len(data) - kinds[4]
    counts = Counter(words)
    same = sum(map(bytes.__eq__, words, words[1:]))
    ended = sum(x.rstrip()[-1] in ".!?" for x in lines)
    root = lambda x: float(np.sqrt(x))
    return [
        float(np.log1p(len(data))),
        float(np.log1p(black / n)),
        root(kinds[2] / black),
        root(kinds[3] / black),
        root(kinds[5] / black),
        root(kinds[6] / black),
        root(len(counts) / n) * float(np.log1p(n)) / 6,
        root(max(counts.values()) / n),
        root(same / n),
        float(np.log1p(n / len(lines))),
        root(ended / len(lines)),
    ]


def features(docs: DataFrame, text_col: str = "text", drop_text: bool = False) -> DataFrame:
    """docs with x: array<double> of FEATURES (underscores are added if docs has such a column)."""
    (x,) = fresh(docs, "x")

    def make():
        return lambda texts: [pa.array([statistics(t) for t in texts], pa.list_(pa.float64()))]

    return with_text_columns(docs, text_col, [T.StructField(x, T.ArrayType(T.DoubleType()))], make, drop_text)


@dataclass
class Model:
    """Priors (log), means, and for each class the inverse Cholesky factor and half the log determinant; None: constant."""

    constant: float | None
    prior: np.ndarray | None = None
    mean: np.ndarray | None = None
    whiten: np.ndarray | None = None
    logdet: np.ndarray | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        """P(label 1) for each row of x."""
        if self.constant is not None:
            return np.full(len(x), self.constant)
        log = []
        for k in range(2):
            y = (x - self.mean[k]) @ self.whiten[k].T
            log.append(self.prior[k] - self.logdet[k] - 0.5 * (y * y).sum(axis=1))
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (label, x) -> (label, i, v): this task's count, sums and sums of products, for each label."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        label = batch.column(0).to_numpy(zero_copy_only=False)
        x = np.array(batch.column(1).to_pylist(), float).reshape(len(label), -1)
        for k in np.unique(label).tolist():
            y = np.column_stack([np.ones((label == k).sum()), x[label == k]])
            sums[k] = sums.get(k, 0) + y.T @ y
    for k, s in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([k] * s.size, pa.int32()), pa.array(range(s.size), pa.int32()), pa.array(s.ravel())], names=["label", "i", "v"])


def fit(examples: DataFrame, pooled: float = 0.5, diagonal: float = 0.0) -> Model:
    """A model from rows (label 0/1, x). Sums of products are aggregated on the executors; (1 + d)^2 numbers a class are collected.

    pooled: the share of the pooled covariance in a class's; diagonal: the share of its own diagonal after that; by
    cross-validation within rows that aren't held out, 0.5 to 1 of the former and none of the latter differ by less
    than a thousandth. Rows with null or other labels don't count. Without examples of both classes every score is the
    share of label 1, or 0.5 without any.
    """
    rows = examples.where("label in (0, 1)").select(F.col("label").cast("int").alias("label"), "x").mapInArrow(_moments, "label int, i int, v double")
    rows = rows.groupBy("label", "i").agg(F.sum("v").alias("v")).collect()
    d = len(FEATURES) + 1
    s = np.zeros((2, d * d))
    for r in rows:
        s[r["label"], r["i"]] = r["v"]
    s = s.reshape(2, d, d)
    n = s[:, 0, 0]
    if (n == 0).any():
        return Model(float(n[1] / n.sum()) if n.sum() else 0.5)
    mean = s[:, 0, 1:] / n[:, None]
    cov = np.array([s[k, 1:, 1:] / n[k] - np.outer(mean[k], mean[k]) for k in range(2)])
    both = (cov * n[:, None, None]).sum(axis=0) / n.sum()
    whiten, logdet = [], []
    for k in range(2):
        c = (1 - pooled) * cov[k] + pooled * both
        c = (1 - diagonal) * c + diagonal * np.diag(np.diag(c)) + 1e-6 * np.eye(d - 1)
        low = np.linalg.cholesky(c)
        whiten.append(np.linalg.inv(low))
        logdet.append(np.log(np.diag(low)).sum())
    return Model(None, np.log(n / n.sum()), mean, np.array(whiten), np.array(logdet))


def scored_texts(docs: DataFrame, model: Model, text_col: str = "text", drop: bool = False) -> DataFrame:
    """docs with score (double), from their texts in one pass; with drop, without the texts."""
    (name,) = fresh(docs, "score")

    def make():
        return lambda texts: [pa.array(model.score(np.array([statistics(t) for t in texts])))]

    return with_text_columns(docs, text_col, [T.StructField(name, T.DoubleType())], make, drop)


def is_held_out(id_col: str = "doc_id"):
    """Documents that are never learned from: crc32 of the id as text, modulo 4, is 2. Null ids are held out."""
    return F.coalesce(F.crc32(col(id_col).cast("string")) % 4 == 2, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = EXAMPLES) -> Model:
    """fit() on the labelled documents that aren't held out: on the first `most` labels by a hash of their ids, if there
    are more. Only their texts are looked at."""
    y = labels.where(~is_held_out(id_col) & col(label_col).isin(0, 1)).select(col(id_col).alias("key"), col(label_col).cast("int").alias("label"))
    y = written(y.orderBy(F.xxhash64("key"), "key", "label").limit(most))
    d = docs.select(col(id_col).alias("id"), col(text_col).alias("text")).join(F.broadcast(y), F.col("id") == F.col("key")).select("label", "text")
    return fit(features(d, "text", drop_text=True))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """(id, held_out, score, predicted) for each row of docs.

    predicted is 1 where score >= threshold. Null and empty texts, and those of white space, have the statistics 0 and
    a score like any other; repeated rows have equal scores. An empty table gives no rows.
    """
    s = scored_texts(docs.select(col(id_col), col(text_col)), train(docs, labels, id_col, text_col), text_col, drop=True)
    return s.select(col(id_col), is_held_out(id_col).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of docs that score at least threshold, with docs' columns; null and empty texts have a score like any other."""
    s = scored_texts(docs, train(docs, labels, id_col, text_col), text_col)
    return s.where(F.col(s.columns[-1]) >= threshold).select(*[col(c) for c in docs.columns])
