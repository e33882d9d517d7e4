"""Centroid clustering: plain Lloyd over integer vectors.

Kept are vectors with exactly 64 components, none null, NaN or infinite; a component x becomes the integer
floor(256 * x), x as a double. The first centroids are the kept vectors with the smallest SHA-256 of ``2:<vec_id>``. A
round broadcasts the centroids (k x 64 integers, a fixed size), lets mapInPandas compute the squared differences to each of
them in NumPy, takes the lowest index of the least, and sums components by cluster: in integers within a partition, then
over partitions by groupBy. A task sends k rows at most, whatever the size of its clusters, and the driver gets k rows.
The integer vectors are written once and read in every round, so a lost executor costs a read.

Sums are exact at any size: a component's sum is carried as sums of its low 32 bits and of the rest. Differences are
int32 or int64 where the values' bound allows it and Python integers beyond. Components beyond what a long holds are held
to the range of a long, as Spark's floor does, and a distance or sum of distances beyond it is given as its largest value.

Edge cases: a null vector and one of another length are left out. Rows with a null vec_id are clustered like any other and
are first centroids only where too few others exist. Repeated ids and rows are clustered as often as they come; among
equal ids the smaller vector (component by component) comes first as a centroid. Fewer vectors than k give as many
centroids as vectors; no vector gives no row. Other columns of the input are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .common import materialize

K, ROUNDS, DIM, SEED = 40, 5, 64, 2
MOST = (1 << 63) - 1


def integers(vectors: DataFrame, vector: str = "embedding", dim: int = DIM) -> DataFrame:
    """(vec_id, v): the kept vectors as arrays of longs."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))  # NaN is above infinity
    return vectors.where((F.size(v) == dim) & finite).select("vec_id", F.transform(v, lambda x: F.floor(x * 256).cast("long")).alias("v"))


def first_centroids(kept: DataFrame, k: int = K, seed: int = SEED) -> list[list[int]]:
    """The k kept vectors of the smallest hashes, by a top-k."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [list(r.v) for r in kept.select("v", key.alias("key")).orderBy(F.asc_nulls_last("key"), "v").limit(k).collect()]


def nearest(v: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest centroid (lowest of ties) and the squared distance, in integers throughout."""
    bound = max(int(np.abs(v.astype(np.float64)).max(initial=0)), max(abs(x) for c in centroids for x in c))
    kind = np.int32 if 4 * bound * bound * v.shape[1] < 1 << 31 else np.int64 if 4 * bound * bound * v.shape[1] < 1 << 63 else object
    v = v.astype(kind)
    distance = np.empty((len(v), len(centroids)), dtype=kind)
    for j, c in enumerate(centroids):
        d = v - np.array(c, dtype=kind)
        distance[:, j] = (d * d).sum(axis=1)
    index = distance.argmin(axis=1)
    least = distance[np.arange(len(v)), index]
    return index, (np.minimum(least, MOST) if kind is object else least).astype(np.int64)


def _stacked(pdf: pd.DataFrame, dim: int) -> np.ndarray:
    return np.stack(pdf["v"].to_list()) if len(pdf) else np.empty((0, dim), np.int64)


def sums(kept: DataFrame, centroids: list[list[int]]) -> list[Row]:
    """A row per non-empty cluster: its size and, per component, the sum of the low 32 bits and of the rest."""
    shared, dim = kept.sparkSession.sparkContext.broadcast(centroids), len(centroids[0])

    def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k = len(shared.value)
        n, low, high = np.zeros(k, np.int64), np.zeros((k, dim), np.int64), np.zeros((k, dim), np.int64)
        for pdf in batches:
            v = _stacked(pdf, dim)
            index, _ = nearest(v, shared.value)
            n += np.bincount(index, minlength=k)
            np.add.at(low, index, v & 0xFFFFFFFF)
            np.add.at(high, index, v >> 32)
        some = np.flatnonzero(n)
        if len(some):
            yield pd.DataFrame({"cluster": some, "n": n[some], "low": list(low[some]), "high": list(high[some])})

    parts = kept.mapInPandas(added, "cluster int, n long, low array<long>, high array<long>")
    total = [F.sum(F.col(c)[i]) for c in ("low", "high") for i in range(dim)]
    return parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*total[:dim]).alias("low"), F.array(*total[dim:]).alias("high")).collect()


def moved(centroids: list[list[int]], found: list[Row]) -> list[list[int]]:
    """Floor of the exact mean per component; empty clusters keep their centroid."""
    out = list(centroids)
    for r in found:
        out[r.cluster] = [((high << 32) + low) // r.n for low, high in zip(r.low, r.high, strict=True)]
    return out


def digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def fit(kept: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED) -> list[list[int]]:
    """The centroids after the rounds; none where no vector is kept."""
    centroids = first_centroids(kept, k, seed)
    for _ in range(rounds if centroids else 0):
        centroids = moved(centroids, sums(kept, centroids))
    return centroids


def assign(kept: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""
    if not centroids:
        return kept.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).where("false")
    shared, dim = kept.sparkSession.sparkContext.broadcast(centroids), len(centroids[0])

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            index, distance = nearest(_stacked(pdf, dim), shared.value)
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "cluster": index, "distance": distance})

    kind = dict(kept.dtypes)["vec_id"]  # as text on the way: pandas would turn longs beside a null into doubles
    placed_ = kept.select(F.col("vec_id").cast("string"), "v").mapInPandas(placed, "vec_id string, cluster int, distance long")
    return placed_.withColumn("vec_id", F.col("vec_id").cast(kind))


def cluster(vectors: DataFrame, vector: str = "embedding", k: int = K, rounds: int = ROUNDS, seed: int = SEED, dim: int = DIM) -> DataFrame:
    """Per kept vector: vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of its final centroid."""
    kept = materialize(integers(vectors, vector, dim))
    centroids = fit(kept, k, rounds, seed)
    placed = materialize(assign(kept, centroids))
    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    by = {r.cluster: r.s for r in placed.groupBy("cluster").agg(total.alias("s")).collect()}  # k rows at most
    held = lambda s: min(int(s), MOST)
    rows = [(c, held(s), held(sum(by.values())), digest(centroids[c])) for c, s in by.items()]
    of = vectors.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
