"""Centroid clustering: Lloyd's rounds in exact integers.

A round reads the vectors' integers, with the centroids in every task: squared differences to one centroid after the
other, the nearest (the lower number of equals), and the sums of a partition's vectors by cluster, which merge in a
groupBy. Only these sums come to the driver, a row a cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scimap.llm.common import col, fits, written

#: Components from here on are refused: their distances may not fit 64 bits.
FAR = 1 << 21


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x the nearest centroid, the lowest of equals, and its squared distance."""
    distance = np.empty((len(centroids), len(x)), np.int64)
    for i, c in enumerate(centroids):
        off = x - c
        distance[i] = (off * off).sum(1)
    best = distance.argmin(0)
    return best, distance[best, np.arange(len(x))]


def integers(vectors: DataFrame, id_col: str, vector_col: str, length: int, scale: int) -> DataFrame:
    """(id, v) as a written table: floor(scale * x) of the vectors of that length without null or non-finite components."""
    refuse = F.raise_error(F.lit(f"components of {FAR} and more have no exact distances in 64 bits"))
    whole = F.transform(col(vector_col), lambda x: F.when(F.abs(x) < FAR, F.floor(x.cast("double") * scale).cast("int")).otherwise(refuse))
    kept = vectors.where(fits(col(vector_col)) & (F.size(col(vector_col)) == length))
    return written(kept.select(col(id_col).alias("id"), whole.alias("v")))


def seeded(table: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest sha256 of `seed:id`; equal ids by components, null ids last."""
    by = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    rows = table.select("v", by.alias("h")).orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()  # k rows
    return np.array([r.v for r in rows], np.int64)


def round_sums(table: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Of each cluster that has vectors: how many, and the sums of their components."""
    k, length = centroids.shape
    names = [f"s{i}" for i in range(length)]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, counts = np.zeros((k, length), np.int64), np.zeros(k, np.int64)
        for part in parts:
            if len(part):
                x = np.stack(part["v"].to_numpy()).astype(np.int64)
                best, _ = nearest(x, centroids)
                counts += np.bincount(best, minlength=k)
                for c in np.unique(best):
                    sums[c] += x[best == c].sum(0)
        some = np.flatnonzero(counts)
        yield pd.DataFrame({"cluster": some.astype(np.int32), "n": counts[some]} | {n: sums[some, i] for i, n in enumerate(names)})

    schema = T.StructType([T.StructField("cluster", T.IntegerType())] + [T.StructField(n, T.LongType()) for n in ["n", *names]])
    own = table.select("v").mapInPandas(run, schema)
    exact = [F.sum(F.col(n).cast("decimal(20,0)")).alias(n) for n in names]
    rows = own.groupBy("cluster").agg(F.sum("n").alias("n"), *exact).collect()  # a row a cluster
    return {r.cluster: (r.n, [int(r[n]) for n in names]) for r in rows}


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 16, length: int = 64, rounds: int = 3, scale: int = 64, seed: int = 1) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid) a vector; distances are squared and exact.

    Components are floor(scale * x). The k vectors with the smallest sha256 of `seed:id` are the first centroids; each of
    `rounds` rounds assigns every vector and replaces each centroid that has vectors by the floor of their mean; then
    vectors are assigned once more. Inertias are the distances' sums, over the vector's cluster and over all.

    Vectors that are null, of another length, or with null or non-finite components are dropped. Null ids, repeated rows
    and equal vectors are vectors like any other; with fewer than k vectors there are as many centroids. An empty table
    gives no rows. Components of 2**21 or more are refused with an error, since their distances don't fit the result.
    Other columns are not read.
    """
    table = integers(vectors, id_col, vector_col, length, scale)
    centroids = seeded(table, k, seed).reshape(-1, length)
    for _ in range(rounds if len(centroids) else 0):
        for c, (n, sums) in round_sums(table, centroids).items():
            centroids[c] = [s // n for s in sums]

    @F.pandas_udf("cluster int, distance long")
    def assign(v: pd.Series) -> pd.DataFrame:
        if not len(v):
            return pd.DataFrame({"cluster": np.zeros(0, np.int32), "distance": np.zeros(0, np.int64)})
        best, distance = nearest(np.stack(v.to_numpy()).astype(np.int64), centroids)
        return pd.DataFrame({"cluster": best.astype(np.int32), "distance": distance})

    d = written(table.select("id", assign("v").alias("to")).select("id", "to.cluster", "to.distance"), small=True)
    sums = {r.cluster: int(r.s) for r in d.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()}  # a row a cluster
    rows = [(c, s, sum(sums.values()), centroids[c].tolist()) for c, s in sums.items()]
    found = table.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid array<bigint>")
    return d.join(F.broadcast(found), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")  # k rows
