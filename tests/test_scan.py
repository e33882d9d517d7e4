"""Scans in two levels against windows, with a key that holds a third of the rows."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tenure.operators import linkage, pairing, scan

DAY = dt.date(2020, 1, 1)
PARTS = 8


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    keys = ["hot"] * 1000 + [None] * 40 + [f"k{int(i)}" for i in rng.integers(0, 300, 2000)]
    day = lambda: None if rng.random() < 0.02 else DAY + dt.timedelta(days=int(rng.integers(0, 900)))
    value = lambda: None if rng.random() < 0.6 else float(rng.normal())
    out = [(i, k, day(), value()) for i, k in enumerate(keys)]
    return spark.createDataFrame(out, "id long, k string, d date, v double").repartition(5).cache()


@pytest.mark.parametrize("keys", [["k"], []])
def test_scan_equals_the_window(rows, keys):
    w = Window.partitionBy(*keys).orderBy("d", "id")
    want = rows.withColumns({
        "n": F.row_number().over(w).cast("long"), "all": F.count("*").over(Window.partitionBy(*keys)), "before": F.lag("v").over(w),
        "held": F.last("v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
    })
    got = scan.scanned(rows, keys, ["d", "id"], number="n", total="all", previous={"before": "v"}, latest={"held": "v"}, parts=PARTS)
    assert got.columns == want.columns and sorted(got.collect(), key=lambda r: r.id) == sorted(want.collect(), key=lambda r: r.id)


def test_a_hot_key_takes_many_parts(rows, monkeypatch):
    seen = []
    keep = scan.written
    monkeypatch.setattr(scan, "written", lambda df, name: seen.append(keep(df, name)) or seen[-1])
    scan.scanned(rows, ["k"], ["d", "id"], number="n", parts=PARTS)
    parts = {r["__part"]: r["count"] for r in seen[0].groupBy("__part").count().collect()}
    assert seen[0].where("k = 'hot'").select("__part").distinct().count() > 2 and max(parts.values()) < 2 * rows.count() / PARTS


def test_carries_are_two_rows_a_part_at_most(rows):
    table = rows.withColumnRenamed("d", "__o0").repartitionByRange(PARTS, "k", "__o0", "id").withColumn("__part", F.spark_partition_id()).cache()
    assert scan._carries(table, ["k"], ["__o0"], {}, {}).count() <= 2 * PARTS


def test_empty_tables_and_equal_rows(rows):
    none = rows.where("false")
    assert scan.scanned(none, ["k"], ["d"], number="n", total="all", previous={"p": "v"}, latest={"l": "v"}).isEmpty()
    same = rows.select(F.lit("a").alias("k"), F.lit(DAY).alias("d"), F.lit(1).alias("x"))
    got = scan.scanned(same, ["k"], ["d"], number="n", total="all", parts=PARTS)
    n = rows.count()
    assert sorted(r.n for r in got.collect()) == list(range(1, n + 1)) and {r["all"] for r in got.collect()} == {n}


def test_as_of_by_key_with_a_hot_key_and_days_missing(rows, spark):
    right = rows.where("id % 3 = 0").select("k", F.col("d").alias("seen"), "v")
    left = rows.where("id % 3 > 0").select("id", "k", "d").unionByName(rows.where("id % 3 > 0").select("id", "k", "d"))
    got = sorted((r.id, r.v) for r in linkage.as_of(left, right.where("v is not null"), "d", "seen", "v", keys=["k"]).fillna(99.0).collect())
    known: dict = {}
    for r in right.where("v is not null and seen is not null").collect():
        known.setdefault(r.k, {}).setdefault(r.seen, []).append(r.v)
    want = []
    for r in left.collect():
        days = [d for d in known.get(r.k, {}) if r.d is not None and d <= r.d]
        want.append((r.id, max(known[r.k][max(days)]) if days else 99.0))
    assert got == sorted(want)


def test_dense_codes_of_values_that_begin_alike(rows, spark):
    values = rows.select(F.format_string("parcel-%06d", F.col("id") % 700).alias("p")).union(spark.createDataFrame([(None,)], "p string"))
    got = {r.p: r.code for r in pairing.dense_codes(values, "p", "code").collect()}
    assert got == {f"parcel-{i:06d}": i for i in range(700)}


def test_flags_of_equal_sales_are_as_many(spark):
    sale = spark.createDataFrame([("p", DAY, 1.0)] * 2 + [(None, DAY, 1.0), ("p", None, 1.0)], "bbl string, sale_date date, price double")
    filing = spark.createDataFrame([("p", DAY, 9.0)], "bbl string, doc_date date, amount double")
    got = linkage.window_flags(sale, filing, {"base": (-15, 90)}, amount_in="base").collect()
    assert sorted((r.financed_base, r.mort_amt) for r in got) == [(0, 0.0), (0, 0.0), (1, 9.0), (1, 9.0)]
