import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tenure.llm import simhash as sh

from .helpers import awkward, empty, table


def brute(text):
    w = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64(x, seed=42).intdigest() for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(fps):
    """Components of all links, quadratically."""
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(fps))]


def check(rows):
    ids, fps = [r[0] for r in rows], [r[1] for r in rows]
    root = classes(fps)
    least = {}
    for i, c in zip(ids, root):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    return [least.get(c) for c in root]


@pytest.mark.parametrize("docs", [lambda s: table(s, "documents"), awkward, empty])
def test_equals_brute_force(spark, docs):
    d = docs(spark)
    texts = d.select("doc_id", "text").collect()
    want = check([(r.doc_id, brute(r.text)) for r in texts])
    want = sorted(((r.doc_id, f"{brute(r.text):016x}", c) for r, c in zip(texts, want)), key=str)
    got = sorted((tuple(r) for r in sh.near_duplicates(d).collect()), key=str)
    assert got == want


def test_spark_hash_is_the_contracts(spark):
    x = "abc déf 中文"
    got = spark.createDataFrame([(x,)], "x string").select(F.xxhash64("x")).first()[0]
    assert got % 2**64 == xxhash.xxh64(x.encode(), seed=42).intdigest()


@pytest.mark.parametrize("block", [4096, 5])
def test_planted_links_in_dense_cells(spark, block):
    rng = random.Random(1)
    centre, fps = rng.getrandbits(64), []
    for _ in range(150):  # chains around one centre: cells hold many points
        x = rng.choice(fps) if fps and rng.random() < 0.8 else centre
        for b in rng.sample(range(64), rng.randint(0, 4)):
            x ^= 1 << b
        fps.append(x)
    fps += [rng.getrandbits(64) for _ in range(150)]
    rows = [(i, x) for i, x in enumerate(dict.fromkeys(fps))]
    signed = [(i, x - 2**64 if x >= 2**63 else x) for i, x in rows]
    df = spark.createDataFrame(signed, "doc_id long, fp long")
    got = {r["__fp"]: r.component_id for r in sh._placed(df, block=block).collect()}
    want = check(rows)
    assert [got[s] for _, s in signed] == want


def test_lower_bound_and_cells():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2**63, 300, dtype=np.uint64)
    b = a.copy()
    for k in range(300):
        for bit in rng.choice(64, rng.integers(0, 4), replace=False):
            b[k] ^= np.uint64(1) << np.uint64(bit)
    d = sh.manhattan(sh.embed(a), sh.embed(b))
    pop = lambda x: [[(int(v) >> 2 * s & 3).bit_count() for s in range(32)] for v in x]
    assert d.tolist() == [sum(abs(p - q) for p, q in zip(x, y)) for x, y in zip(pop(a), pop(b))]
    assert (d <= np.bitwise_count(a ^ b)).all()
    assert (sh.cells(a, 6, 3) == sh.cells(b, 6, 3)).any(axis=1).all()


def test_finer_cells_keep_links_and_shrink():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 2**63, 400, dtype=np.uint64)
    b = a.copy()
    for k in range(400):
        for bit in rng.choice(64, 3, replace=False):
            b[k] ^= np.uint64(1) << np.uint64(bit)
    x, y = sh.cells(a, 6, 3), sh.cells(b, 6, 3)
    for k in range(400):
        grids = np.flatnonzero(x[k] == y[k])
        assert len(grids)
        for g in grids:
            both = np.array([a[k], b[k]])
            f = sh.finer(both, np.full(2, x[k, g]), np.full(2, g), 6, 3, 5)
            assert (f[0] == f[1]).any()
    one = np.full(4000, 7, dtype=np.int64)  # points that share nothing but a cell
    fine = sh.finer(rng.integers(0, 2**63, 4000, dtype=np.uint64), one, np.zeros(4000, dtype=np.int64), 6, 3, 5)
    assert np.unique(fine, return_counts=True)[1].max() < 200


def test_crowded_cells_are_split_before_they_are_dealt(spark):
    rng = np.random.default_rng(5)
    low = rng.integers(0, 2**24, 3000, dtype=np.uint64)  # the upper half is one for all
    df = spark.createDataFrame([(int(x),) for x in np.unique(low)], "fp long")
    plain = sh.gridded(df, block=10**6).groupBy("cell").count().agg(F.max("count")).first()[0]
    split = sh.gridded(df, block=300)
    assert plain > 2000 and split.groupBy("cell", "i", "j").count().agg(F.max("count")).first()[0] <= 900
    want = classes([int(x) for x in np.unique(low)][:800])
    some = spark.createDataFrame([(i, int(x)) for i, x in enumerate(np.unique(low)[:800])], "doc_id long, fp long")
    got = {r["__fp"]: r.component_id for r in sh._placed(some, block=100).collect()}
    least = {}
    for i, c in enumerate(want):
        least.setdefault(c, i)
    assert [got[int(x)] for x in np.unique(low)[:800]] == [least[c] for c in want]


def test_equal_rows_leave_one(spark):
    d = spark.createDataFrame([(1, "a b c d", k % 2) for k in range(40)] + [(2, "a b c d", 0), (None, None, 0), (None, None, 0)], "doc_id long, text string, k int").repartition(6)
    assert sorted(((r.doc_id, r.text) for r in sh.keep_one(d).collect()), key=str) == [(1, "a b c d"), (None, None)]


def test_one_of_each_group_stays(spark):
    d = awkward(spark)
    kept = sh.keep_one(d)
    assert kept.columns == d.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 2, 5, 6, 8]
    assert [r.text for r in kept.collect() if r.doc_id is None] == ["A row without id."]
