"""Algebra of the estimators: against full least squares, brute force, finite differences and known tails."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenure.operators import density, estimation, pairing, resampling
from tenure.plans.registry import Tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pairs(spark):
    return Tables(spark, SF).enriched.cache()


@pytest.fixture(scope="module")
def sample(pairs):
    return resampling.sample(pairs, "borough", "bbl", order=["bbl", "sale_id_z"], flags=["financed_base_a", "financed_base_z"])


def full(s, w=None):
    w = np.ones(len(s.y)) if w is None else w
    x = np.column_stack([s.q, s.x]) * np.sqrt(w)[:, None]
    return np.linalg.lstsq(x, s.y * np.sqrt(w), rcond=None)[0][:2]


def test_partialling_out_equals_full_least_squares(pairs, sample):
    result, influence = estimation.contrast(pairs, "borough", "bbl")
    b = full(sample)
    assert result["beta"] == pytest.approx(b.tolist(), abs=1e-8) and result["max_nuisance_score"] < 1e-6
    assert resampling.half(resampling.wls(sample.x, sample.q, sample.y, np.ones(len(sample.y)))[0]) == pytest.approx(result["pi_joint"], abs=1e-8)
    assert influence.agg(F.sum("inf_joint")).first()[0] == pytest.approx(0, abs=1e-8)
    r = sample.y - sample.x @ np.linalg.lstsq(sample.x, sample.y, rcond=None)[0]
    want = (r[sample.q[:, 0] == 1].mean() - r[sample.q[:, 1] == 1].mean()) / 2
    assert result["pi_residual"] == pytest.approx(want, abs=1e-8)


@pytest.mark.parametrize(("area", "design"), [("borough", {"local": "zipcode", "controls": ["financed_wide"]}), ("zipcode", {}), ("borough", {})])
def test_areas_taken_out_apart_equal_one_solution(pairs, area, design):
    one, by = estimation.contrast(pairs, area, "bbl", apart=False, **design)
    apart, by_apart = estimation.contrast(pairs, area, "bbl", apart=True, **design)
    for k, v in one.items():
        assert apart[k] == pytest.approx(v, abs=1e-8), k
    other = {r.bbl: (r.inf_joint, r.inf_residual) for r in by_apart.collect()}
    assert all(other[r.bbl] == pytest.approx((r.inf_joint, r.inf_residual), abs=1e-9) for r in by.collect()) and len(other) == one["clusters"]


def test_only_shared_columns_reach_the_driver(pairs):
    entries = estimation.contrast_entries("zipcode")
    fit, coefficients = estimation.solve_apart(estimation.gram(pairs, entries, block="zipcode"), ["cf", "fc"], "q:")
    assert fit.nuisance == [] and coefficients.count() == pairs.select(F.explode(estimation.calendar("zipcode")).alias("e")).select("e.k").distinct().count()


def test_weights_of_the_contrast(pairs):
    result, _ = estimation.contrast(pairs, "borough", "bbl")
    rows, _ = estimation.contrast_weights(pairs, "borough", ["y", "cf", "fc"])
    r = rows.agg(F.sum(F.col("k") * F.col("y")), F.sum(F.col("k") * F.col("cf")), F.sum(F.col("k") * F.col("fc"))).first()
    assert list(r) == pytest.approx([result["pi_joint"], 0.5, -0.5], abs=1e-8)


def test_influence_is_the_derivative_by_cluster_weight(pairs, sample):
    _, influence = estimation.contrast(pairs, "borough", "bbl")
    by = {r.bbl: r.inf_joint for r in influence.collect()}
    ids = np.array([r.bbl for r in pairs.orderBy("bbl", "sale_id_z").select("bbl").collect()])
    for bbl in sorted(by)[:4]:
        w = np.ones(len(ids))
        step = 1e-5
        up, down = w + step * (ids == bbl), w - step * (ids == bbl)
        slope = (resampling.half(full(sample, up)) - resampling.half(full(sample, down))) / (2 * step)
        assert slope == pytest.approx(by[bbl], abs=1e-7)


def test_weighted_fit_equals_full_weighted_fit(sample):
    w = 1.0 + np.arange(len(sample.y)) % 3
    b, _ = resampling.wls(sample.x, sample.q, sample.y, w)
    assert b == pytest.approx(full(sample, w), abs=1e-8)


def test_union_covariance_equals_enumeration(spark):
    s = np.random.default_rng(7).normal(size=(9, 2))
    a, z, p = [1, 2, 3, 1, 4, 5, 3, 2, 6], [2, 1, 3, 4, 5, 6, 6, 4, 6], [0, 1, 2, 3, 0, 4, 5, 2, 7]
    df = spark.createDataFrame([(i, j, k, *map(float, v)) for i, j, k, v in zip(a, z, p, s)], "a int, z int, p int, s0 double, s1 double")
    brute = sum(np.outer(s[i], s[j]) for i in range(9) for j in range(9) if p[i] == p[j] or {a[i], z[i]} & {a[j], z[j]})
    assert estimation.union_covariance(df, "a", "z", "p", ["s0", "s1"]) == pytest.approx(brute, abs=1e-10)


def test_tails():
    assert estimation.t_tail(2.0, 10) == pytest.approx(0.03669402, abs=1e-7)
    assert estimation.t_quantile(0.975, 39) == pytest.approx(2.0226909, abs=1e-6)
    assert estimation.f_tail(3.0, 2, 39) == pytest.approx((1 + 2 * 3.0 / 39) ** (-39 / 2), abs=1e-9)
    assert estimation.t_quantile(0.025, 5) == pytest.approx(-2.5705818, abs=1e-6)


def test_diagnostics_clip_negative_eigenvalues():
    d = estimation.diagnostics(np.array([1.0, 2, 3, 4]), np.diag([1.0, 1, 1, 1]) - 1e-3 * np.eye(4)[::-1], 30)
    assert d["clipped"] == 0 and 0 < d["joint_p"] < 1e-3
    assert estimation.diagnostics(np.array([1.0]), np.array([[-1.0]]), 5, slice(0, 0))["clipped"] == 1


def test_huber_ignores_an_outlier(sample):
    y = sample.y.copy()
    y[3] += 1000
    ones = np.ones(len(y))
    plain, robust = resampling.huber(sample.x, sample.q, sample.y, ones)[0], resampling.huber(sample.x, sample.q, y, ones)[0]
    assert abs(robust - plain).max() < 0.2 and abs(resampling.wls(sample.x, sample.q, y, ones)[0] - full(sample)).max() > 0.2


def test_weighted_quantile_matches_the_distributed_one(spark):
    rng = np.random.default_rng(1)
    v, w = rng.normal(size=40), rng.integers(0, 4, 40).astype(float)
    df = spark.createDataFrame([("g", float(a), float(b)) for a, b in zip(v, w)], "g string, v double, w double")
    shares = [0.0, 0.01, 0.3, 0.5, 0.99, 1.0]
    got = {r.share: r.quantile for r in pairing.weighted_quantile(df, "v", "w", shares, ["g"]).collect()}
    want = resampling.weighted_quantile(v[w > 0], w[w > 0], [100 * s for s in shares])
    assert [got[s] for s in shares] == pytest.approx(want.tolist(), abs=1e-12)


def test_draws_are_numpys_sequence(spark, sample):
    rng, g = np.random.default_rng(20260909), int(sample.cluster.max()) + 1
    want = [resampling.ols(sample, rng.multinomial(g, np.repeat(1 / g, g))[sample.cluster].astype(float))["ols"] for _ in range(4)]
    got = {r.draw: r.value for r in resampling.bootstrap(spark, sample, resampling.ols, draws=4).collect()}
    assert [got[i] for i in range(4)] == pytest.approx(want, abs=1e-10)


@pytest.mark.parametrize("groups", [["p"], ["p", "t"], ["p", "t", "q"]])
def test_effects_that_don_t_settle_are_an_error(spark, monkeypatch, groups):
    monkeypatch.setattr(resampling, "LEVELS", 0)
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(int(rng.integers(9)), int(rng.integers(9)), int(rng.integers(3)), float(rng.normal())) for _ in range(60)], "p int, t int, q int, y double")
    done = resampling.absorb(df, ["y"], groups)
    assert all(done.groupBy(g).agg(F.abs(F.avg("y")).alias("m")).agg(F.max("m")).first()[0] < 1e-8 for g in groups)
    if len(groups) > 1:
        with pytest.raises(RuntimeError, match="did not settle"):
            resampling.absorb(df, ["y"], groups, steps=2)


@pytest.mark.parametrize("levels", [500, 0])
def test_two_way_effects_equal_dummies(spark, monkeypatch, levels):
    monkeypatch.setattr(resampling, "LEVELS", levels)
    rng = np.random.default_rng(5)
    rows = [(f"p{i}", f"t{t}", float(rng.normal()), float(rng.random() < 0.5)) for i in range(12) for t in rng.choice(6, 4, replace=False)]
    df = spark.createDataFrame(rows, "bbl string, period string, y double, x double")
    p, t = [sorted({r[k] for r in rows}) for k in (0, 1)]
    x = np.array([[r[3]] + [float(r[0] == a) for a in p] + [float(r[1] == b) for b in t] for r in rows])
    want = np.linalg.lstsq(x, np.array([r[2] for r in rows]), rcond=None)[0][0]
    assert resampling.two_way(df, "y", "x", "bbl", ["bbl", "period"])["beta"] == pytest.approx(want, abs=1e-7)


def test_recodings(spark):
    rows = [(0, 2.0, 0, 1), (1, 1.0, 1, 0), (2, 0.5, 0, 0), (3, -1.0, 1, 1)]
    df = spark.createDataFrame(rows, "i long, r double, financed_base_a int, financed_base_z int")
    got = {(r.i, r.end): r.effect for r in resampling.candidates(df, "i", "r").collect()}
    assert got == {(0, "a"): 2.0, (0, "z"): 2.0, (1, "a"): -1.0, (1, "z"): -1.0, (2, "a"): 0.5, (2, "z"): -0.5, (3, "a"): 1.0, (3, "z"): -1.0}


def test_bunching_finds_planted_mass(spark):
    rng = np.random.default_rng(3)
    v = rng.uniform(700_000, 1_300_000, 60_000)
    move = (v >= 1_000_000) & (v < 1_020_000) & (rng.random(len(v)) < 0.5)
    v[move] = 995_000
    df = spark.createDataFrame([(float(x),) for x in v], "p double")
    r = density.bunching(df, "p", [1e6], half=300_000, width=10_000, below=20_000, above=20_000, degree=3).first()
    assert r.M == pytest.approx(move.sum(), rel=0.2) and r.B == pytest.approx(move.sum(), rel=0.2)


@pytest.mark.parametrize(("exact", "bin_"), [("above", 30), ("below", 29)])
def test_a_sale_at_the_threshold(spark, exact, bin_):
    df = spark.createDataFrame([(1e6,)] * 5 + [(9e5,)], "p double")
    low = 1e6 - 300_000 + 10_000 * np.arange(60)
    counts = np.zeros(60)
    counts[bin_], counts[20] = 5, 1
    want = density.fit_counts(low, counts, 1e6, half=300_000, width=10_000, exact=exact)
    got = density.bunching(df, "p", [1e6], exact=exact).first()
    assert got.M == pytest.approx(want["M"], abs=1e-6) and got.B == pytest.approx(want["B"], abs=1e-6)


def test_covariance_of_estimates_with_themselves(pairs):
    result, influence = estimation.contrast(pairs, "borough", "bbl")
    cov = {(r.i, r.j): r.covariance for r in estimation.joint_covariance({"a": influence, "b": influence}, "bbl").collect()}
    assert all(v == pytest.approx(result["se_joint"] ** 2, rel=1e-9) for v in cov.values()) and len(cov) == 4


def test_differences_of_two_periods(spark):
    rng = np.random.default_rng(8)
    v, late = rng.uniform(500_000, 1_500_000, 40_000), rng.random(40_000) < 0.5
    move = late & (v >= 1e6) & (v < 1_100_000) & (rng.random(len(v)) < 0.4)
    v[move] = 995_000
    df = spark.createDataFrame([(float(x), bool(k)) for x, k in zip(v, late)], "p double, late boolean")
    post = F.col("late")
    cuts = {"all": (~post, post), "none": (~post, ~post)}
    rows = density.differences(df, "p", 1e6, cuts, 40, 1, degree=3).cache()
    point = {r.cut: r for r in rows.where("draw is null").collect()}
    share = lambda p: density.fit_counts(600_000 + 10_000 * np.arange(80), np.histogram(p, 600_000 + 10_000 * np.arange(81))[0], 1e6, half=400_000, width=10_000, below=50_000, above=100_000, degree=3)["share"]
    count = lambda p, a, b: ((p >= a) & (p < b)).sum()
    ratio = lambda p: np.log(count(p, 1e6, 1.1e6) / count(p, 850_000, 950_000))
    assert point["all"].difference == pytest.approx(share(v[late]) - share(v[~late]), abs=1e-8) and point["all"].difference == pytest.approx(0.4, abs=0.1)
    assert point["all"].log_ratio == pytest.approx(ratio(v[late]) - ratio(v[~late]), abs=1e-12) and point["none"].log_ratio == 0
    # the spread of the log ratio is that of independent counts
    want = sum(1 / count(p, a, b) for p in (v[late], v[~late]) for a, b in ((1e6, 1.1e6), (850_000, 950_000))) ** 0.5
    assert rows.where("cut = 'all' and draw >= 0").agg(F.stddev("log_ratio")).first()[0] == pytest.approx(want, rel=0.4)
    for column, found in (("difference", point["all"].difference), ("log_ratio", point["all"].log_ratio)):
        r = {x.cut: x for x in density.difference_intervals(rows, column).collect()}
        assert r["all"].low < found == r["all"][column] < r["all"].high < (0 if column == "log_ratio" else 1) and r["all"].draws == 40
        assert r["none"].low < 0 < r["none"].high
    with pytest.raises(ValueError):
        density.differences(df, "p", 1e6, cuts, 1, 1, high=(0, 105_000))


def test_extent_of_a_planted_hole(spark):
    v = np.arange(400_000, 1_600_000, 25.0)
    v = v[(v < 1e6) | (v >= 1_030_000)]
    rows = density.hole_extent(spark.createDataFrame([(float(x),) for x in v], "p double"), "p", 1e6).orderBy("low").collect()
    assert [r.low for r in rows] == [1e6 + 10_000 * k for k in range(11)]
    assert [r.ratio for r in rows] == pytest.approx([0.0] * 3 + [1.0] * 8, abs=1e-6)


def test_the_whole_grid(spark):
    from tenure.plans.catalogue import QUERIES

    rows = QUERIES["m33_specification_grid"](spark, SF).select("degree", "band", "width", "half").collect()
    assert {r.degree for r in rows} == {2, 3, 4, 5, 6, 7} and {r.half for r in rows} == {150_000, 200_000, 300_000, 400_000, 500_000}
    want = [(d, b, w, h) for d in range(2, 8) for w in (5, 10, 20, 25) for h in (150, 200, 300, 400, 500) for b in (30, 50, 75, 100, 150)]
    want = [(d, b, w, h) for d, b, w, h in want if not (b >= h - 50 or w in (20, 25) and b % w)]
    assert sorted((r.degree, r.band / 1e3, r.width / 1e3, r.half / 1e3) for r in rows) == sorted(want)


def test_designs_by_distinct_rows_equal_dense_ones(sample):
    assert len(sample.design.distinct) < len(sample.y) and (sample.x == sample.design.distinct[sample.design.code]).all()
    w = 1.0 + np.arange(len(sample.y)) % 3
    for x in (sample.design, sample.x):
        beta, e = resampling.wls(x, sample.q, sample.y, w)
        assert beta == pytest.approx(full(sample, w), abs=1e-8) and sample.x.T @ (e * w) == pytest.approx(np.zeros(sample.x.shape[1]), abs=1e-7)


def test_the_kappa_sweep(spark):
    from tenure.plans.catalogue import QUERIES

    rows = sorted(QUERIES["m29_kappa_sweep"](spark, SF).collect())
    assert [(r.kappa, r.draws) for r in rows] == [(k / 10, 96) for k in range(11)]
    assert rows[-1].value < rows[0].value  # the more tilted, the lower the contrast
    at = QUERIES["m29_kappa_crossing"](spark, SF).first().crossing
    want = [a.kappa + (b.kappa - a.kappa) * a.value / (a.value - b.value) for a, b in zip(rows, rows[1:]) if a.value > 0 >= b.value]
    assert at == (pytest.approx(want[0], abs=1e-9) if want else None)


def test_draws_of_the_queries(spark, monkeypatch):
    from tenure.plans.catalogue import QUERIES

    from tenure.operators import passes, relabel

    given = {}
    for module, names in ((resampling, ["bootstrap"]), (passes, ["bootstrap", "fit_all_draws", "screened", "split", "index_draws"]), (relabel, ["hidden_labels", "relabelling"])):
        for f in names:  # few draws are run, the number asked for is kept
            whole = getattr(module, f)
            monkeypatch.setattr(module, f, lambda *a, whole=whole, f=f, draws, **k: given.setdefault(f, []).append(draws) or whole(*a, draws=3, **k))
    for name in ("m07_bootstrap", "m07_bootstrap_publication", "m15_robust_differences", "m16_split", "m17_screens_common_draws", "m30_sequential_screens", "m24_index_draws",
                 "m25_index_draws", "m27_hidden_labels", "m29_misclassification"):
        QUERIES[name](spark, SF)
    assert given == {"bootstrap": [999, 999, 3], "fit_all_draws": [999], "split": [999], "screened": [999, 999], "index_draws": [400, 250], "hidden_labels": [200], "relabelling": [200]}
    assert QUERIES["m26_placebo_labels"](spark, SF).select("draw").distinct().count() == 400


def test_passes_equal_the_collected_sample(pairs, sample):
    from tenure.operators import passes

    rows = passes.rows_of(pairs, "borough", "bbl")
    ones = np.ones(len(sample.y))
    want = resampling.fit_all(sample, ones)
    got = passes.fit_all(rows)
    assert got == pytest.approx(want, abs=1e-6)
    beta, named, scale = passes.huber(rows, ["cf", "fc"])
    assert beta.tolist() == pytest.approx(resampling.huber(sample.design, sample.q, sample.y, ones)[0].tolist(), abs=1e-6)
    w = pairs.withColumn("weight", 1.0 + F.col("sale_id_z") % 3)
    weights = np.array([r.weight for r in w.orderBy("bbl", "sale_id_z").select("weight").collect()])
    weighted = passes.rows_of(w, "borough", "bbl", weight=F.col("weight"))
    assert passes.least_squares(weighted, ["cf", "fc"])[0].beta.tolist() == pytest.approx(full(sample, weights).tolist(), abs=1e-8)
    assert passes.mad_scale(passes.residuals(weighted, named), "e") > 0


def test_draws_by_passes_equal_fits_with_the_same_weights(spark, pairs, sample, monkeypatch):
    from tenure.operators import passes

    monkeypatch.setattr(passes, "HELD", 3000)
    rows = passes.rows_of(pairs, "borough", "bbl")
    got = {r.draw: r.value for r in passes.bootstrap(rows, {"ols": ("cf", "fc")}, draws=40, seed=3).collect()}
    hashes = np.array([r[0] for r in pairs.orderBy("bbl", "sale_id_z").select(F.xxhash64("bbl")).collect()])
    w = passes.poisson(hashes, np.arange(40), 3)
    assert len(got) == 40 and abs(w.mean() - 1) < 0.05 and abs(w.var() - 1) < 0.1
    for d in (0, 7, 39):
        assert got[d] == pytest.approx(resampling.half(full(sample, w[:, d])), abs=1e-8)
    flag = F.col("src") == "BUILDING"
    both = passes.split(pairs, flag, "borough", "bbl", draws=2, seed=3).collect()
    some = {(r.draw, r.estimator): r.value for r in passes.screened(pairs, {"all": F.lit(True), "b": ~flag}, "borough", "bbl", draws=2, seed=3).collect()}
    assert len(both) == 4 and some[0, "all"] == pytest.approx(got[0], abs=1e-8) and len(some) == 4


@pytest.mark.parametrize("n", [0, 1, 7, 5000])
def test_quantiles_by_passes(spark, monkeypatch, n):
    from tenure.operators import passes, search

    monkeypatch.setattr(search, "FEW", 5)
    rng = np.random.default_rng(n)
    v, w = rng.normal(size=n).round(2 if n == 7 else 9), rng.integers(0, 4, n).astype(float)
    v[: n // 3] = 0.25  # a hot value
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(v, w)], "v double, w double")
    for share in (0.0, 0.01, 0.3, 0.5, 0.975, 1.0):
        got = passes.quantile(df, "v", "w", share)
        keep = w > 0
        if not keep.any():
            assert np.isnan(got)
            continue
        values, inverse = np.unique(v[keep], return_inverse=True)
        sums, least = np.bincount(inverse, w[keep]), np.array([w[keep][inverse == k].min() for k in range(len(values))])
        upto = np.cumsum(sums)
        middle = np.stack([upto - sums + least / 2, upto - least / 2], axis=1).ravel()
        assert got == pytest.approx(np.interp(share * sums.sum(), middle, np.repeat(values, 2)), abs=1e-12)
        if n == 5000:
            same = df.withColumn("w", F.lit(1.0))
            assert passes.quantile(same, "v", "w", share) == pytest.approx(resampling.weighted_quantile(v, np.ones(n), [100 * share])[0], abs=1e-12)


def test_subset_of_the_index_and_its_fit(spark, pairs, sample):
    from tenure.plans.catalogue import QUERIES

    x = sample.x
    r = sample.y - x @ np.linalg.lstsq(x, sample.y, rcond=None)[0]
    src = np.array([p.src for p in pairs.orderBy("bbl", "sale_id_z").select("src").collect()])
    for row in QUERIES["m25_subset_of_index"](spark, SF).collect():
        own = src == row.src
        cf, fc = own & (sample.q[:, 0] == 1), own & (sample.q[:, 1] == 1)
        assert row.half_difference == pytest.approx((r[cf].mean() - r[fc].mean()) / 2, abs=1e-8)
    fits = {f.design: f for f in QUERIES["m26_index_fit"](spark, SF).collect()}
    want = 1 - (r @ r) / (sample.y @ sample.y), 1 - (r @ r) / ((sample.y - sample.y.mean()) ** 2).sum()
    assert (fits["all"].uncentred, fits["all"].centred) == pytest.approx(want, abs=1e-8)
    assert fits["base"].columns < fits["all"].columns and fits["base"].uncentred == pytest.approx(want[0], abs=1e-8)
