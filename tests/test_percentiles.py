"""Percentiles dealt by ranges against the aggregate that holds a group's values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenure.operators import screens, summary

SHARES = {"least": 0.0, "low": 0.025, "third": 0.333, "middle": 0.5, "high": 0.975, "most": 1.0}


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    out = [(g, float(v)) for g, n in (("hot", 3000), ("small", 7), ("one", 1)) for v in rng.normal(size=n)]
    out += [("tied", 2.5)] * 400 + [("tied", 1.0)] * 3 + [(None, float(i)) for i in range(10)] + [("void", None)] * 2 + [("holes", None), ("holes", 4.0), ("holes", 6.0)]
    return spark.createDataFrame(out, "g string, v double").repartition(4).cache()


@pytest.mark.parametrize("groups", [["g"], [], ["g", "h"]])
def test_percentiles_equal_the_aggregate(rows, groups):
    df = rows.withColumn("h", F.when(F.col("v") > 0, 1))
    want = df.groupBy(*groups).agg(*[F.percentile("v", s).alias(n) for n, s in SHARES.items()])
    key = lambda r: repr([r[g] for g in groups])
    got, want = ({key(r): [r[n] for n in SHARES] for r in x.collect()} for x in (summary.percentiles(df, "v", SHARES, groups), want))
    assert got.keys() == want.keys()
    for k, values in want.items():
        assert got[k] == (values if values[0] is None else pytest.approx(values, abs=1e-12))


def test_profile_and_empty_tables(rows):
    got = {r.g: r for r in summary.profile(rows, "v", ["g"]).collect()}
    assert (got["tied"].n, got["tied"].p25, got["holes"].median, got["void"].median, got[None].p75) == (403, 2.5, 5.0, None, 6.75)
    assert summary.profile(rows, "v", []).first().n == rows.count()
    none = rows.where("false")
    assert summary.percentiles(none, "v", SHARES, ["g"]).isEmpty() and screens.trimmed(none, "v", 0.1).isEmpty()


def test_screens_by_percentiles(rows):
    held = screens.above_group_quantile(rows, "v", ["g"], 0.1)
    assert {r.g: r["count"] for r in held.groupBy("g").count().collect()} == {"hot": 2700, "small": 7, "one": 1, "tied": 400, "void": 2, "holes": 3}
    assert screens.trimmed(rows.where("g = 'hot'"), "v", 0.01).count() == 2940
    assert {r.tercile: r["count"] for r in screens.terciles(rows.where("g = 'hot'"), "v", "g").groupBy("tercile").count().collect()} == {1: 999, 2: 1002, 3: 999}
