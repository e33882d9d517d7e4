"""Solved estimates by the equations that define them, which SQL states without solving: scores add up to zero.

Least squares, Huber's estimator and the weights of a contrast are the only solutions of their equations, so a query
gives each column of the design with its mean score, and the SQL the columns with what that has to be.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenure.functions.measures import switched, trend_years
from tenure.operators import density, estimation, linkage, passes, resampling
from tenure.operators.sampling import uniform
from tenure.operators.summary import half_difference, mix
from tenure.operators.tables import written

from .registry import query, rounded

TARGETS = ["cf", "fc"]
QUARTER = "cast((year(d) - 2016) * 4 + (month(d) - 1) // 3 as integer)"


def columns_sql(rows: str = "enriched", targets: tuple[str, ...] = ("t:cf", "t:fc")) -> str:
    """The columns of a design over the rows of a view, with zero."""
    ends = f"select borough, date_a as d from {rows} union all select borough, date_z from {rows}"
    names = f"select distinct concat('q:', borough, ':', cast({QUARTER} as varchar)) as k from ({ends}) where {QUARTER} <> 0"
    return " union all ".join([f"select k, cast(0 as double) as score from ({names})", *[f"select '{t}', cast(0 as double)" for t in targets]])


def scores(rows: DataFrame, named: dict[str, float], weight: Column | None = None) -> DataFrame:
    """Mean score of each column at the coefficients."""
    n = rows.count()
    left = passes.residuals(rows, named).withColumn("s", F.col("e") * (F.col("w") if weight is None else weight))
    sums = left.select(F.explode("x").alias("x"), "s").where("x.k <> 'y'").groupBy(F.col("x.k").alias("k")).agg(F.sum(F.col("x.v") * F.col("s")).alias("s"))
    return sums.select("k", (F.round(F.col("s") / n, 6) + F.lit(0.0)).alias("score"))


def _rows(t, pairs=None, **design) -> DataFrame:
    return passes.rows_of(t.enriched if pairs is None else pairs, "borough", "bbl", **design)


def _without(rows: DataFrame, *names: str) -> DataFrame:
    return rows.withColumn("x", F.filter("x", lambda e: ~e["k"].isin(*names)))


@query("m04_normal_equations", columns_sql())
def m04(t):
    rows = _rows(t)
    return scores(rows, passes.least_squares(rows, TARGETS)[1])


@query("m09_rate_normal_equations", columns_sql(targets=("t:cf", "t:fc", "t:slope_a", "t:slope_z")))
def m09(t):
    rated = linkage.as_of(t.enriched, t.rates, "date_a", "observed", "rate").withColumnRenamed("rate", "rate_a")
    rated = linkage.as_of(rated, t.rates, "date_z", "observed", "rate").withColumnRenamed("rate", "rate_z")
    extra = {f"slope_{s}": F.col(f"financed_base_{s}") * (F.coalesce(f"rate_{s}", F.lit(19.0)) - 19) for s in "az"}
    rows = _rows(t, rated, extra=extra)
    return scores(rows, passes.least_squares(rows, [*TARGETS, *extra])[1])


@query("m10_index_normal_equations", columns_sql(targets=()))
def m10(t):
    """The index alone: its residuals, whose half-difference m10_index_residual takes, are orthogonal to the calendar."""
    rows = _without(_rows(t), "t:cf", "t:fc")
    return scores(rows, passes.least_squares(rows, [])[1])


@query("m11_weighted_normal_equations", columns_sql())
def m11(t):
    rows = _rows(t, weight=1 + F.col("sale_id_z") % 3)
    return scores(rows, passes.least_squares(rows, TARGETS)[1])


@query("m13_huber_normal_equations", columns_sql())
def m13(t):
    """Huber's estimating equations, at the scale of its last weights."""
    rows = _rows(t)
    _, named, scale = passes.huber(rows, TARGETS)
    return scores(rows, named, F.least(F.lit(1.0), F.lit(resampling.HUBER * scale) / F.greatest(F.abs("e"), F.lit(1e-12))))


@query("m16_split_normal_equations", columns_sql(targets=("t:cf1", "t:fc1", "t:cf0", "t:fc0")))
def m16(t):
    own = (F.col("src") == "BUILDING").cast("double")
    four = {"cf1": F.col("cf") * own, "fc1": F.col("fc") * own, "cf0": F.col("cf") * (1 - own), "fc0": F.col("fc") * (1 - own)}
    rows = _without(_rows(t, extra=four), "t:cf", "t:fc")
    return scores(rows, passes.least_squares(rows, list(four))[1])


@query("m20_trend_normal_equations", columns_sql(targets=("t:cf", "t:fc", "t:slope_a", "t:slope_z")))
def m20(t):
    extra = {f"slope_{s}": F.col(f"financed_base_{s}") * trend_years(F.col(f"date_{s}"), "1998-01-01") for s in "az"}
    rows = _rows(t, extra=extra)
    return scores(rows, passes.least_squares(rows, [*TARGETS, *extra])[1])


@query("m21_weight_equations", f"select k, case k when 't:cf' then 0.5 when 't:fc' then -0.5 else 0.0 end as product from ({columns_sql()})")
def m21(t):
    """The weights of the contrast give it back from any outcome: products with the calendar are zero, with the arms a half."""
    entries = F.filter(estimation.contrast_entries("borough"), lambda e: e["k"] != "y")
    rows, _ = estimation.contrast_weights(t.enriched.withColumn("own", entries), "borough", ["own"])
    sums = rows.select(F.explode("own").alias("x"), "k").groupBy(F.col("x.k").alias("k")).agg(F.sum(F.col("x.v") * F.col("k")).alias("s"))
    return sums.select("k", (F.round("s", 6) + F.lit(0.0)).alias("product"))


@query("m25_index_equations", columns_sql("(select * from enriched where cf = 0 and fc = 0)", ()))
def m25(t):
    rows = _without(_rows(t, t.enriched.where("cf = 0 and fc = 0")), "t:cf", "t:fc")
    return scores(rows, passes.least_squares(rows, [])[1])


@query("m35_window_normal_equations", " union all ".join(f"select '{w}' as win, k, score from ({columns_sql()})" for w in ("strict", "base", "wide")))
def m35(t):
    """The contrast's equations under each financing window, pairs and calendar held fixed."""
    out = None
    for w in ("strict", "base", "wide"):
        cf, fc = switched(F.col(f"financed_{w}_a"), F.col(f"financed_{w}_z"))
        rows = _rows(t, t.kept.withColumns({"cf": cf, "fc": fc}))
        own = scores(rows, passes.least_squares(rows, TARGETS)[1]).select(F.lit(w).alias("win"), "k", "score")
        out = own if out is None else out.unionByName(own)
    return out


@query("m06_influence_sums", "select cast(0 as double) as joint, cast(0 as double) as residual, count(distinct zipcode) as clusters from enriched")
def m06(t):
    """Influences by ZIP code add up to zero."""
    _, influence = estimation.contrast(t.enriched, "borough", "zipcode")
    zero = lambda c: F.round(F.sum(c), 6) + F.lit(0.0)
    return influence.agg(zero("inf_joint").alias("joint"), zero("inf_residual").alias("residual"), F.count("*").alias("clusters"))


PERIOD = "concat(borough, ':', cast((year(sale_date) - 2016) * 4 + (month(sale_date) - 1) // 3 as varchar))"


@query("m23_absorbed_means", f"""select 'bbl' as kind, count(distinct bbl) as n, cast(0 as double) as largest from sales
    union all select 'period', count(distinct {PERIOD}), cast(0 as double) from sales""")
def m23(t):
    """What alternating projections leave has mean zero in every parcel and every period."""
    from tenure.functions.measures import quarter_index

    f = t.sales.select("bbl", F.concat_ws(":", "borough", quarter_index(F.col("sale_date")).cast("string")).alias("period"), F.log("price").alias("y"))
    left, out = resampling.absorb(f, ["y"], ["bbl", "period"]), None
    for g in ("bbl", "period"):
        means = left.groupBy(g).agg(F.avg("y").alias("m"))
        own = means.agg(F.lit(g).alias("kind"), F.count("*").alias("n"), (F.round(F.max(F.abs("m")), 6) + F.lit(0.0)).alias("largest"))
        out = own if out is None else out.unionByName(own)
    return out


@query("m24_row_duplication", """with k as (select bbl, cast(row_number() over (order by bbl) - 1 as bigint) as i from (select distinct bbl from enriched)), g as (select count(*) as n from k),
    s as (select d, cast(floor((cast(concat('0x', substr(md5(concat('24:', cast(d as varchar), '|', cast(k.i as varchar))), 1, 12)) as bigint) + 0.5) / 281474976710656.0 * n) as bigint) as i from k, g, range(250) r(d)),
    e as (select s.d, arm, y from s join k on k.i = s.i join enriched on enriched.bbl = k.bbl)
    select cast(d as integer) as draw, round((avg(y) filter (arm = 'cf') - avg(y) filter (arm = 'fc')) / 2, 6) as half_difference, count(*) as n from e group by 1""")
def m24(t):
    """Parcels drawn with replacement, their pairs as often as they come, 250 times; draws by a hash of draw and place."""
    p = t.kept.select("bbl", "arm", "y")
    # numbers in the order of the keys from a range sort's parts, without one task for all
    ranged = written(p.select("bbl").distinct().repartitionByRange("bbl").sortWithinPartitions("bbl").select("bbl", F.monotonically_increasing_id().alias("m")), "numbers")
    parts = sorted(ranged.groupBy(F.shiftright("m", 33).alias("part")).count().collect())  # a row a task
    before = np.concatenate([[0], np.cumsum([r["count"] for r in parts])]).tolist()
    offset = t.spark.createDataFrame([(r["part"], int(b)) for r, b in zip(parts, before, strict=False)], "part long, before long")
    k = ranged.join(F.broadcast(offset), F.shiftright("m", 33) == F.col("part")).select("bbl", (F.col("before") + F.col("m").bitwiseAND((1 << 33) - 1)).alias("i"))
    # a parcel's sums meet the draws of it, dealt by its number: no pair is copied for a draw
    side = lambda a, c: F.coalesce(F.sum(F.when(F.col("arm") == a, c)), F.lit(0))
    arms = {f"{s}_{a}": side(a, c) for a in ("cf", "fc") for s, c in (("y", F.col("y")), ("n", F.when(F.col("y").isNotNull(), 1)))}
    parcels = k.join(p.groupBy("bbl").agg(*[c.alias(n) for n, c in arms.items()], F.count("*").alias("n")), "bbl").drop("bbl")
    # numbers are few bytes and lie in few files: hashes, 250 a number, are dealt over all cores
    dealt = k.select("i").repartition(max(t.spark.sparkContext.defaultParallelism, before[-1] * 250 // 4_000_000))
    slots = dealt.select("i", F.explode(F.sequence(F.lit(0), F.lit(249))).alias("draw"))
    drawn = F.floor(uniform(F.concat_ws("|", "draw", "i"), 24) * F.lit(float(before[-1]))).alias("i")
    rows = slots.select("draw", drawn).join(parcels.hint("shuffle_hash"), "i")
    mean = lambda a: F.try_divide(F.sum(f"y_{a}"), F.sum(f"n_{a}"))
    return rows.groupBy("draw").agg(F.round((mean("cf") - mean("fc")) / 2, 6).alias("half_difference"), F.sum("n").alias("n"))


@query("m25_subset_of_index")
def m25_subset(t):
    """Half-differences by segment, of residuals from the index fitted on all pairs."""
    rows = _without(_rows(t, keep=["src", "arm"]), "t:cf", "t:fc")
    return half_difference(passes.residuals(rows, passes.least_squares(rows, [])[1]), "arm", "e", ["src"])


@query("m26_index_fit")
def m26_fit(t):
    """R2, centred and not, of the index with a base period left out and with all periods, where columns are redundant."""
    out = []
    for name, base in (("base", 1995), ("all", 2016)):
        entries = F.concat(estimation.calendar("borough", base_year=base), F.array(F.struct(F.lit("y").alias("k"), F.col("y").alias("v"))))
        rows = written(t.enriched.select(entries.alias("x"), "y", F.lit(1.0).alias("w"), F.lit(0).alias("c"), F.lit(0.0).alias("g")), "design")
        fit, named = passes.least_squares(rows, [])
        m = passes.residuals(rows, named).agg(F.sum(F.col("e") * F.col("e")).alias("left"), F.sum(F.col("y") * F.col("y")).alias("yy"), F.var_pop("y").alias("v"), F.count("*").alias("n")).first()
        out.append((name, len(fit.nuisance), 1 - m["left"] / m["yy"], 1 - m["left"] / (m["v"] * m["n"])))
    return t.spark.createDataFrame(out, "design string, columns int, uncentred double, centred double")


def _bins_equations(t, rows, groups: list[str]):
    """Mean product of the powers of the distance with what the fitted density leaves of each bin outside the band."""
    out = []
    for h in (100_000.0, 200_000.0, 300_000.0):
        counts = density.bins(rows, "price", h - 90_000, h + 90_000, 5_000, groups)
        by: dict[tuple, list] = {}
        for r in counts.orderBy("bin").collect():  # 36 bins a group
            by.setdefault(tuple(r[g] for g in groups), []).append((r["low"], r["n"]))
        for key, part in by.items():
            low, n = np.array(part, dtype=float).T
            middle, band, fitted = density.counterfactual(low, n, h, half=90_000, width=5_000, below=10_000, above=20_000)
            x = (middle - h) / 90_000
            out += [(*key, h, k, round(float(((n - fitted) * x**k)[~band].mean()), 4) + 0.0) for k in range(6)]
    types = dict(rows.dtypes)
    return t.spark.createDataFrame(out, ", ".join([*[f"{g} {types[g]}" for g in groups], "threshold double, power int, score double"]))


@query("m31_bunching_equations", "select cast(h as double) as threshold, cast(k as integer) as power, cast(0 as double) as score from (values (100000), (200000), (300000)) v(h), range(6) p(k)")
def m31(t):
    return _bins_equations(t, t.sales, [])


@query("m34_bunching_equations_by_type", "select g as financed_strict, cast(h as double) as threshold, cast(k as integer) as power, cast(0 as double) as score from (select distinct financed_strict as g from flagged), (values (100000), (200000), (300000)) v(h), range(6) p(k)")
def m34(t):
    return _bins_equations(t, t.flagged, ["financed_strict"])


@query("g18_log_change", """with r as (select count(*) filter (sale_date < date '1998-01-01' and price >= 200000 and price < 250000) as a0, count(*) filter (sale_date < date '1998-01-01' and price < 200000 and price >= 150000) as b0,
    count(*) filter (sale_date >= date '1998-01-01' and price >= 200000 and price < 250000) as a1, count(*) filter (sale_date >= date '1998-01-01' and price < 200000 and price >= 150000) as b1 from sales)
    select round(ln(cast(a1 as double) / b1) - ln(cast(a0 as double) / b0), 6) as log_change from r""")
def g18(t):
    """The change from before to after of the log of sales above over sales below."""
    rows = t.sales.withColumn("period", F.when(F.col("sale_date") < "1998-01-01", "pre").otherwise("post"))
    return rounded(density.log_change(density.above_below(rows, "price", "period", 200_000, 50_000), "period", "pre", "post"))


@query("g19_mix", """with s as (select src, borough, cast(year(sale_date) as varchar) as y from sales), u as (select src, 'borough' as kind, borough as level from s union all select src, 'year', y from s)
    select src, kind, level, count(*) as n, round(cast(count(*) as double) / sum(count(*)) over (partition by src, kind), 6) as share from u group by 1, 2, 3""")
def g19_mix(t):
    """How each segment's sales are spread over boroughs and years."""
    return rounded(mix(t.sales.withColumn("year", F.year("sale_date")), ["src"], ["borough", "year"]))


@query("g19_matched_share", "select cast(year(sale_date) as integer) as year, count(*) as n, round(avg(financed_base), 6) as matched from flagged group by 1")
def g19_matched(t):
    """Share of each year's sales that a filing was found for."""
    return rounded(t.flagged.groupBy(F.year("sale_date").alias("year")).agg(F.count("*").alias("n"), F.avg("financed_base").alias("matched")))


@query("k06_density_series", """with b as (select cast(floor((price - 110000) / 5000) as integer) as bin, count(*) as n from sales where price >= 110000 and price < 290000 group by 1)
    select cast(i as integer) as bin, cast(110000 + 5000 * i as double) as low, cast(coalesce(n, 0) as bigint) as n, round(cast(coalesce(n, 0) as double) / (select sum(n) from b), 6) as share from range(36) r(i) left join b on b.bin = r.i""")
def k06_density(t):
    """The series of a figure: bins around a threshold and their shares."""
    counts = density.bins(t.sales, "price", 110_000, 290_000, 5_000)
    total = counts.agg(F.sum("n").alias("total"))
    return rounded(counts.crossJoin(F.broadcast(total)).withColumn("share", F.col("n") / F.col("total")).drop("total"))


@query("k06_yearly_series", """with e as (select cast(year(date_z) as integer) as year, arm, y from enriched)
    select year, arm, count(*) as n, round(avg(y), 6) as mean, round(avg(y) - 1.96 * stddev_samp(y) / sqrt(count(*)), 6) as low, round(avg(y) + 1.96 * stddev_samp(y) / sqrt(count(*)), 6) as high from e group by 1, 2""")
def k06_yearly(t):
    """The series of a figure: mean growth by year of resale and arm, with its band."""
    rows = t.enriched.groupBy(F.year("date_z").alias("year"), "arm").agg(F.count("*").alias("n"), F.avg("y").alias("mean"), (F.stddev_samp("y") / F.sqrt(F.count("*"))).alias("se"))
    return rounded(rows.withColumns({"low": F.col("mean") - 1.96 * F.col("se"), "high": F.col("mean") + 1.96 * F.col("se")}).drop("se"))


@query("m07_draws_by_passes")
def m07_passes(t):
    """Intervals over 999 draws whose weights are hashed, for any number of pairs."""
    return resampling.intervals(passes.bootstrap(_rows(t), {"ols": ("cf", "fc")}))


@query("m14_estimators_by_passes")
def m14_passes(t):
    rows = [(k, float(v)) for k, v in passes.fit_all(_rows(t)).items()]
    return t.spark.createDataFrame(rows, "estimator string, value double")


@query("m16_split_by_passes")
def m16_passes(t):
    return resampling.intervals(passes.split(t.enriched, F.col("src") == "BUILDING", "borough", "bbl"))


@query("m17_m30_screens_by_passes")
def m30_passes(t):
    """Screens one after another on common draws, for any number of pairs."""
    building, high = F.col("src") != "BUILDING", F.col("src") != "MACHINERY"
    draws = passes.screened(t.enriched, {"all": F.lit(True), "1": building, "1+2": building & high}, "borough", "bbl")
    return resampling.paired_differences(draws, "all")
