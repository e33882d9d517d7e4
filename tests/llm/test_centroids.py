"""Lloyd's rounds against a brute-force version in Python integers, on awkward vectors and values of every size."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from tenure.llm import centroids

from .helpers import table

SCHEMA = "vec_id long, embedding array<double>, cluster string, v string"


def brute(rows, k=40, rounds=5, dim=64):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    cs = [v for _, v in order[:k]]

    def place():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cs)) for _, v in kept]

    for _ in range(rounds):
        at = place()
        for j in range(len(cs)):
            own = [v for (_, v), (_, c) in zip(kept, at) if c == j]
            if own:
                cs[j] = [sum(x) // len(own) for x in zip(*own)]
    at, total = place(), {}
    for d, j in at:
        total[j] = total.get(j, 0) + d
    held, name = lambda x: min(x, (1 << 63) - 1), [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cs]
    return sorted(map(repr, ((i, j, held(d), held(total[j]), held(sum(total.values())), name[j]) for (i, _), (d, j) in zip(kept, at))))


def same(spark, rows, **more):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA).repartition(3)
    got = centroids.cluster(df, **more)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(repr(tuple(r)) for r in got.collect()) == brute(rows, **more)


def test_whole_table_equals_brute_force(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in table(spark, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).collect()]
    same(spark, rows)


def test_awkward_vectors(spark):
    far, nan = float("inf"), float("nan")
    bad = [(90, None), (91, []), (92, [1.0, 2.0]), (93, [0.0, None, 0.0, 0.0]), (94, [nan, 0.0, 0.0, 0.0]), (95, [far, 0.0, 0.0, 0.0]), (96, [-far] * 4)]
    good = [(i, [math.sin(i * j) for j in range(4)]) for i in range(50)] + [(None, [0.5] * 4), (None, [-0.5] * 4), (3, [9.0] * 4), (7, [0.25] * 4), (7, [0.25] * 4)]
    same(spark, good + bad, dim=4, k=6)
    big = (1 << 53) + 1  # an id that a double can't hold, beside a null
    same(spark, [(big, [0.0] * 4), (None, [1.0] * 4)], dim=4, k=1)


@pytest.mark.parametrize("scale", [1.0, 3e4, 2e6, 1e15])
def test_values_of_every_size(spark, scale):
    same(spark, [(i, [scale * math.cos(i + j) for j in range(4)]) for i in range(40)], dim=4, k=5, rounds=3)


def test_fewer_vectors_than_centroids_and_none(spark):
    same(spark, [(i, [float(i)] * 4) for i in range(3)], dim=4)
    assert centroids.cluster(spark.createDataFrame([], SCHEMA)).count() == 0


def test_ties_go_to_the_lower_number(spark):
    same(spark, [(i, [float(i % 3 - 1), 0.0]) for i in range(30)], dim=2, k=8)


def test_sums_send_a_row_a_cluster(spark):
    kept = centroids.integers(spark.range(5000).select(F.col("id").alias("vec_id"), F.array_repeat(F.lit(0.5), 4).alias("embedding")).repartition(4), dim=4)
    assert [(r.cluster, r.n, r.low) for r in centroids.sums(kept, [[0] * 4, [128] * 4])] == [(1, 5000, [640_000] * 4)]
