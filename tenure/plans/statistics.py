"""Queries of the estimators. The sums that feed them are checked by SQL elsewhere; solved results by tests."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tenure.functions.measures import quarter_index, trend_years
from tenure.operators import density, estimation, linkage, passes, relabel, resampling

from tenure.operators.tables import written

from .registry import Tables, query

SUMMARY = ("pairs", "clusters", "cf", "fc", "nuisance_columns", "pi_joint", "se_joint", "pi_residual", "se_residual", "information_fraction")
#: Draws as the study takes them: bootstraps, a cell or scenario of the stress tests, placebos, densities.
DRAWS, STRESS_DRAWS, PLACEBO_DRAWS, DENSITY_DRAWS = 999, 200, 400, 600


def _one(t: Tables, rows: list[dict]):
    """A few results of a solved estimate as rows."""
    return t.spark.createDataFrame([{k: float(v) if isinstance(v, (float, np.floating)) else v for k, v in r.items()} for r in rows])


def _contrast(t: Tables, pairs=None, **design):
    result, influence = estimation.contrast(pairs if pairs is not None else t.enriched, "borough", "bbl", **design)
    return result, influence


def _rows(t: Tables, pairs=None, **design):
    return passes.rows_of(t.enriched if pairs is None else pairs, "borough", "bbl", **design)


@query("m04_contrast")
def m04(t):
    """Joint and residual contrasts: calendar by borough, clustered by parcel."""
    result, _ = _contrast(t)
    return _one(t, [{k: result[k] for k in (*SUMMARY, "max_nuisance_score")}])


@query("m04_contrast_local")
def m04_local(t):
    """The same with local years by ZIP code and differences of indicators as controls."""
    result, _ = _contrast(t, local="zipcode", controls=["financed_wide"])
    return _one(t, [{k: result[k] for k in SUMMARY}])


@query("m04_contrast_by_zip")
def m04_zip(t):
    """A calendar of its own for every ZIP code: each is taken out in a task of its own."""
    result, _ = estimation.contrast(t.enriched, "zipcode", "bbl", apart=True)
    return _one(t, [{k: result[k] for k in SUMMARY}])


@query("m05_joint_covariance")
def m05(t):
    """Covariance of the contrasts of three screens, from influences on common parcels."""
    screens = {"all": t.enriched, "not4": t.enriched.where("borough <> '4'"), "high": t.enriched.where("price_a > 100000")}
    return estimation.joint_covariance({n: _contrast(t, p)[1] for n, p in screens.items()}, "bbl")


@query("m06_zip_clusters")
def m06(t):
    result, _ = estimation.contrast(t.enriched, "borough", "zipcode")
    return _one(t, [{k: result[k] for k in SUMMARY}])


@query("m07_bootstrap")
def m07(t):
    """Percentile intervals over common draws of parcels, by hashes, for any number of pairs."""
    return resampling.intervals(passes.bootstrap(_rows(t), {"ols": ("cf", "fc")}, draws=DRAWS))


@query("m07_bootstrap_publication")
def m07_publication(t):
    """The intervals over the 999 draws of a publication: NumPy's multinomial sequence, by blocks where parcels are many."""
    return resampling.intervals(passes.multinomial(_rows(t, keep=["bbl"]), "bbl", {"ols": ("cf", "fc")}, draws=999))


@query("m09_rate_interaction")
def m09(t):
    """Interactions of financing with the rate at each end, the rate as of the sale."""
    rated = linkage.as_of(t.enriched, t.rates, "date_a", "observed", "rate").withColumnRenamed("rate", "rate_a")
    rated = linkage.as_of(rated, t.rates, "date_z", "observed", "rate").withColumnRenamed("rate", "rate_z")
    extra = {f"slope_{s}": F.col(f"financed_base_{s}") * (F.coalesce(f"rate_{s}", F.lit(19.0)) - 19) for s in "az"}
    result, _ = _contrast(t, rated, extra=extra)
    names = ("cf", "fc", *extra)
    return _one(t, [{"term": n, "beta": b, "se": s} for n, b, s in zip(names, result["beta"], result["beta_se"], strict=True)])


@query("m10_index_residual")
def m10(t):
    """Half-difference of the residuals of a repeat-sales index by borough and quarter."""
    result, _ = _contrast(t)
    return _one(t, [{"half_difference": result["pi_residual"], "asymmetry": result["asym_residual"], "cf": result["cf"], "fc": result["fc"]}])


@query("m11_weighted_least_squares")
def m11(t):
    rows = _rows(t, weight=1 + F.col("sale_id_z") % 3)
    fit, named = passes.least_squares(rows, ["cf", "fc"])
    mean = passes.residuals(rows, named).agg(F.avg("e")).first()[0]
    return _one(t, [{"cf": fit.beta[0], "fc": fit.beta[1], "half_difference": resampling.half(fit.beta), "residual_mean": mean}])


@query("m12_weighted_quantile", """with c as (select borough, y, cast(1 + sale_id_z % 3 as double) as w from enriched),
    d as (select *, (sum(w) over (partition by borough order by y rows unbounded preceding) - w / 2) / sum(w) over (partition by borough) as cdf from c),
    e as (select *, lead(cdf) over (partition by borough order by cdf) as c1, lead(y) over (partition by borough order by cdf) as y1 from d)
    select borough, cast(0.5 as double) as share, round(y + (y1 - y) * (0.5 - cdf) / (c1 - cdf), 6) as quantile from e where 0.5 >= cdf and 0.5 < c1""")
def m12(t):
    from tenure.operators.pairing import weighted_quantile

    from .registry import rounded

    rows = t.enriched.withColumn("w", (1 + F.col("sale_id_z") % 3).cast("double"))
    return rounded(weighted_quantile(rows, "y", "w", [0.5], ["borough"]))


@query("m13_huber")
def m13(t):
    rows = _rows(t)
    beta, named, scale = passes.huber(rows, ["cf", "fc"])
    down = passes.residuals(rows, named).agg(F.avg((F.abs("e") > resampling.HUBER * scale).cast("int"))).first()[0]
    return _one(t, [{"half_difference": resampling.half(beta), "down_weighted": down}])


@query("m14_all_estimators")
def m14(t):
    return _one(t, [{"estimator": k, "value": v} for k, v in passes.fit_all(_rows(t)).items()])


@query("m15_robust_differences")
def m15(t):
    """Intervals of the robust estimators less least squares, on the same draws."""
    return resampling.paired_differences(passes.fit_all_draws(_rows(t), draws=DRAWS), "ols")


@query("m15_robust_report")
def m15_report(t):
    """By arm: pairs, the share that Huber's estimator down-weights and the share of growth above 0.7; and every point estimate."""
    rows = _rows(t, keep=["arm", "y"])
    beta, named, scale = passes.huber(rows, ["cf", "fc"])
    arm = F.when(F.col("arm").isin("cf", "fc"), F.col("arm")).otherwise("same").alias("arm")
    by = passes.residuals(rows, named).groupBy(arm).agg(
        F.count("*").alias("pairs"), F.avg((F.abs("e") > resampling.HUBER * scale).cast("int")).alias("down_weighted"), F.avg((F.col("y") > 0.7).cast("int")).alias("tail")
    )
    point = passes.fit_all(rows, beta)
    return by.withColumns({k: F.lit(v) for k, v in point.items()})


@query("m16_split")
def m16(t):
    return resampling.intervals(passes.split(t.enriched, F.col("src") == "BUILDING", "borough", "bbl", draws=DRAWS))


@query("m17_screens_common_draws")
def m17(t):
    draws = passes.screened(t.enriched, {"all": F.lit(True), "building": F.col("src") == "BUILDING"}, "borough", "bbl", draws=DRAWS)
    return resampling.paired_differences(draws, "all")


@query("m18_union_covariance")
def m18(t):
    """Scores' covariance over pairs that share a parcel or an end's quarter."""
    entries = estimation.contrast_entries("borough")
    fit = estimation.solve(estimation.gram(t.kept, entries), ["cf", "fc"])
    ends = t.kept.withColumns({"qa": quarter_index(F.col("date_a")), "qz": quarter_index(F.col("date_z"))})
    rows = written(estimation.scores(ends, entries, fit, ["bbl", "qa", "qz"]), "scores")  # read for each kind of group
    cov = estimation.union_covariance(rows, "qa", "qz", "bbl", ["s0", "s1"])
    return _one(t, [{"i": i, "j": j, "covariance": cov[i, j]} for i in range(2) for j in range(2)])


@query("m19_m20_market_model")
def m20(t):
    """Four targets with trends as nuisance, tested on the nodes of the calendar."""
    p = t.kept
    slope = {f"slope_{s}": F.col(f"financed_base_{s}") * trend_years(F.col(f"date_{s}"), "1998-01-01") for s in "az"}
    entries = estimation.contrast_entries("borough", extra=slope)
    fit = estimation.solve(estimation.gram(p, entries), ["cf", "fc", *slope])
    ends = p.withColumns({"qa": quarter_index(F.col("date_a")), "qz": quarter_index(F.col("date_z"))})
    rows = written(estimation.scores(ends, entries, fit, ["bbl", "qa", "qz"]), "scores")  # read for each kind of group
    cov = estimation.union_covariance(rows, "qa", "qz", "bbl", [f"s{i}" for i in range(4)])
    nodes = ends.select("qa").union(ends.select("qz")).distinct().count()
    d = estimation.diagnostics(fit.beta, cov, nodes - 1)
    names = ("cf", "fc", *slope)
    return _one(t, [{"term": n, "beta": b, "se": s, "joint_p": d["joint_p"], "sum_p": d["sum_p"], "df": d["df"]} for n, b, s in zip(names, fit.beta, d["se"], strict=True)])


@query("m21_contrast_weights")
def m21(t):
    """Weights whose sum with the outcomes is the contrast."""
    rows, _ = estimation.contrast_weights(t.enriched, "borough", ["sale_id_z", "y"])
    return rows.select("sale_id_z", "y", "k")


@query("m22_adverse_outcomes")
def m22(t):
    """The contrast after outcomes of the heaviest parcels move against it."""
    rows, _ = estimation.contrast_weights(t.enriched, "borough", ["bbl", "sale_id_z", "y"])
    heavy = rows.groupBy("bbl").agg(F.sum(F.abs("k")).alias("w")).orderBy(F.desc("w"), "bbl")
    out = None
    for n in (10, 30, 60, 120):
        top = heavy.limit(n).select("bbl", F.lit(1).alias("hit"))
        x = rows.join(F.broadcast(top), "bbl", "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
        for delta in (0.5, 1.0):
            moved = F.col("y") - F.col("hit") * F.signum("k") * delta
            one = x.agg(F.lit(n).alias("parcels"), F.lit(delta).alias("delta"), F.sum(F.col("k") * moved).alias("contrast"))
            out = one if out is None else out.unionByName(one)
    return out


@query("m23_two_way_effects")
def m23(t):
    """Log price on cash with parcel and borough-quarter effects, by alternating projections."""
    f = t.flagged.select(
        "bbl", F.concat_ws(":", "borough", quarter_index(F.col("sale_date")).cast("string")).alias("period"), F.log("price").alias("y"),
        (1 - F.col("financed_strict")).cast("double").alias("cash"),
    )
    return _one(t, [resampling.two_way(f, "y", "cash", "bbl", ["bbl", "period"])])


@query("m25_out_of_sample_index")
def m25(t):
    """An index fitted on pairs that don't switch, scored on those that do."""
    p = t.enriched
    entries = F.concat(estimation.calendar("borough"), F.array(F.struct(F.lit("y").alias("k"), F.col("y").alias("v"))))
    fit = estimation.solve(estimation.gram(p.where("cf = 0 and fc = 0"), entries), [])
    coefficient = t.spark.createDataFrame(list(zip(fit.nuisance, map(float, fit.of_y), strict=True)), "k string, b double")
    rows = p.where("cf = 1 or fc = 1").select("sale_id_z", "arm", "y", F.explode(estimation.calendar("borough")).alias("e"))
    rows = rows.select("sale_id_z", "arm", "y", "e.k", "e.v").join(F.broadcast(coefficient), "k")  # a row per column of the design
    r = rows.groupBy("sale_id_z", "arm", "y").agg((F.col("y") - F.sum(F.col("v") * F.col("b"))).alias("r"))
    from tenure.operators.summary import half_difference

    return half_difference(r, "arm", "r")


@query("m24_index_draws")
def m24(t):
    """Percentiles of the half-difference over 400 draws of parcels, the index fitted anew on each."""
    rows = _rows(t, t.enriched.withColumn("grp", F.concat(F.lit("all|"), "arm")), keep=["grp"])
    draws = passes.index_contrasts(passes.index_draws(rows, "grp", draws=400), least=60)
    return resampling.intervals(draws.withColumnRenamed("segment", "estimator"))


@query("m25_index_draws")
def m25_draws(t):
    """The same by segment, the index fitted on the pairs of all segments of each of 250 draws."""
    rows = _rows(t, t.enriched.withColumn("grp", F.concat_ws("|", "src", "arm")), keep=["grp"])
    draws = passes.index_contrasts(passes.index_draws(rows, "grp", draws=250), least=40)
    return resampling.intervals(draws.withColumnRenamed("segment", "estimator"))


@query("m26_placebo_labels")
def m26(t):
    """Half-differences of the index residuals of pairs that don't switch, labelled by a hash as if they had: 400 draws."""
    rows = _rows(t, keep=["sale_id_z", "arm"]).withColumn("x", F.filter("x", lambda e: ~e["k"].startswith("t:")))
    left = passes.residuals(rows, passes.least_squares(rows, [])[1]).where("arm in ('cc', 'ff')")
    return passes.placebo(left, "e", "sale_id_z", draws=PLACEBO_DRAWS, seed=1)


def _recodings(t):
    return relabel.design(t.enriched, "borough", "bbl", "sale_id_z", "financed_base_a", "financed_base_z")


@query("m27_hidden_labels")
def m27(t):
    """Mean contrast after shares of each switching arm turn out financed at both ends, on all pairs and without one segment."""
    rows = relabel.design(t.enriched, "borough", "bbl", "sale_id_z", "financed_base_a", "financed_base_z", keep=["src"])
    cells = [(a, b) for a in (0.0, 0.1, 0.2) for b in (0.0, 0.1, 0.2)]
    draws = relabel.hidden_labels(rows, cells, draws=STRESS_DRAWS, seed=3, screen=F.col("src") != "BUILDING")
    return draws.groupBy("q_fc", "q_cf").agg(F.avg("full").alias("full"), F.avg("screened").alias("screened"), F.count("*").alias("draws"))


@query("m29_misclassification")
def m29(t):
    """Random, tilted and adversarial recodings, refitted."""
    scenarios = [
        {"name": "random", "h": 0.08, "f": 0.036, "mode": "random"},
        {"name": "tilted_against", "h": 0.08, "f": 0.036, "mode": "tilted", "sign": 1.0},
        {"name": "tilted_for", "h": 0.08, "f": 0.036, "mode": "tilted", "sign": -1.0},
        {"name": "adversarial_against", "h": 0.08, "f": 0.036, "mode": "adversarial", "sign": 1.0},
        {"name": "adversarial_for", "h": 0.08, "f": 0.036, "mode": "adversarial", "sign": -1.0},
    ]
    draws = relabel.relabelling(_recodings(t), scenarios, draws=STRESS_DRAWS, seed=4)
    return draws.groupBy("scenario").agg(F.avg("value").alias("value"), F.max("recoded").alias("recoded"), F.count("*").alias("draws"))


def _sweep(t):
    """Mean contrast by kappa: recodings against the finding, tilted ever more to those that lower it most."""
    kappas = [k / 10 for k in range(11)]
    scenarios = [{"name": f"{k:.1f}", "h": 0.08, "f": 0.036, "mode": "tilted", "sign": 1.0, "kappa": k} for k in kappas]
    draws = relabel.relabelling(_recodings(t), scenarios, draws=96, seed=5)
    kappa = F.col("scenario").cast("double").alias("kappa")
    return draws.groupBy(kappa).agg(F.avg("value").alias("value"), F.max("recoded").alias("recoded"), F.count("*").alias("draws"))


@query("m29_kappa_sweep")
def m29_sweep(t):
    return _sweep(t)


@query("m29_kappa_crossing")
def m29_kappa_crossing(t):
    """The kappa at which the contrast falls to zero; null if it doesn't."""
    return resampling.crossing(_sweep(t), "kappa", "value")


@query("m29_crossing", """with s as (select borough, cast(k as double) / 10 as x, avg(price) filter (financed_base = 1) - 1.2 * avg(price) * k / 10 as y from flagged, range(16) r(k) group by borough, k),
    n as (select *, lead(x) over (partition by borough order by x) as x1, lead(y) over (partition by borough order by x) as y1 from s)
    select borough, round(min(x + (x1 - x) * y / (y - y1)), 6) as crossing from n where y > 0 and y1 <= 0 group by 1""")
def m29_crossing(t):
    """Where a sweep of the sales falls through zero, by borough; m29_kappa_crossing is the sweep of the recodings."""
    from .registry import rounded

    rows = t.flagged.select("borough", "price", "financed_base", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("k"))
    y = F.avg(F.when(F.col("financed_base") == 1, F.col("price"))) - 1.2 * F.avg("price") * F.col("k") / 10
    sweep = rows.groupBy("borough", "k").agg(y.alias("y")).withColumn("x", F.col("k").cast("double") / 10)
    return rounded(resampling.crossing(sweep, "x", "y", ["borough"]))


@query("m30_sequential_screens")
def m30(t):
    """Each screen added to those before, with differences on common draws."""
    building, high = F.col("src") != "BUILDING", F.col("src") != "MACHINERY"
    draws = passes.screened(t.enriched, {"all": F.lit(True), "1": building, "1+2": building & high}, "borough", "bbl", draws=DRAWS)
    return resampling.paired_differences(draws, "all")


THRESHOLDS = [100_000.0, 200_000.0, 300_000.0]


@query("m31_bunching")
def m31(t):
    return density.bunching(t.sales, "price", THRESHOLDS, half=90_000, width=5_000, below=10_000, above=20_000, dummies="nested")


@query("m32_bunching_bootstrap")
def m32(t):
    draws = density.bootstrap(t.sales, "price", 200_000, DENSITY_DRAWS, 5, half=90_000, width=5_000, below=10_000, above=20_000)
    return draws.agg(F.percentile("M", 0.025).alias("low"), F.percentile("M", 0.975).alias("high"), F.avg("M").alias("mean"))


def _dollars(t):
    """Sales at five times their price, so that the study's thresholds and windows in dollars lie within the prices."""
    return t.sales.withColumn("price", F.col("price") * 5)


def _cuts():
    """The study's periods before and after, laid over the years of the test tables: (before, after) by name."""
    day = F.col("sale_date")
    pre, post = day < "1995-04-01", day >= "1996-01-01"
    return {
        "baseline": (pre, post), "late post": (pre, day >= "1997-01-01"), "clean pre": (day < "1995-01-01", post),
        "tight": ((day >= "1993-01-01") & (day < "1995-01-01"), (day >= "1996-01-01") & (day < "1998-01-01")), "late only": (pre, day >= "1998-01-01"),
    }


@query("m32_difference_in_bunching")
def m32_difference(t):
    """Change in the share missing above the threshold, with its interval."""
    rows = density.differences(_dollars(t), "price", 1_000_000, {"baseline": _cuts()["baseline"]}, 600, 6, dummies="nested")
    return density.difference_intervals(rows, "difference")


@query("m32_did_log_ratio")
def m32_did(t):
    """Change in the log ratio of sales above and below, without a polynomial."""
    rows = density.differences(_dollars(t), "price", 1_000_000, {"baseline": _cuts()["baseline"]}, 2000, 7, dummies="nested")
    return density.difference_intervals(rows, "log_ratio")


@query("m32_period_cuts")
def m32_cuts(t):
    """The change under other cuts of the periods."""
    return density.difference_intervals(density.differences(_dollars(t), "price", 1_000_000, _cuts(), 400, 8, dummies="nested"), "difference")


@query("m33_specification_grid")
def m33(t):
    return density.grid(_dollars(t), "price", 1_000_000)


@query("m33_hole_extent")
def m33_hole(t):
    return density.hole_extent(_dollars(t), "price", 1_000_000)


@query("m34_bunching_by_type")
def m34(t):
    return density.bunching(t.flagged, "price", THRESHOLDS, half=90_000, width=5_000, groups=["financed_strict"], below=10_000, above=20_000)


@query("m35_window_sensitivity")
def m35(t):
    """The contrast under each financing window, pairs and calendar held fixed."""
    from tenure.functions.measures import switched

    rows = []
    for w in ("strict", "base", "wide"):
        cf, fc = switched(F.col(f"financed_{w}_a"), F.col(f"financed_{w}_z"))
        result, _ = _contrast(t, t.kept.withColumns({"cf": cf, "fc": fc}))
        rows.append({"window": w, **{k: result[k] for k in ("cf", "fc", "pi_joint", "se_joint")}})
    return _one(t, rows)
