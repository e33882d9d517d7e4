"""Densities around price thresholds: bins, spikes, and the missing or excess mass next to a threshold.

Only bin counts leave the data, so fits and bootstraps work on some dozens of numbers whatever the number of sales.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bins(df: DataFrame, value: str, low: float, high: float, width: float, groups: list[str] | None = None) -> DataFrame:
    """Counts of fixed-width bins from ``low`` to below ``high``, zeros included: ``bin``, ``low``, ``n``."""
    groups = groups or []
    inside = df.where((F.col(value) >= low) & (F.col(value) < high))
    counts = inside.groupBy(*groups, F.floor((F.col(value) - low) / width).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(int(np.ceil((high - low) / width))).select(F.col("id").cast("int").alias("bin"))
    if groups:
        every = inside.select(*groups).distinct().crossJoin(F.broadcast(every))
    out = every.join(counts, [*groups, "bin"], "left")
    return out.select(*groups, "bin", (F.lit(low) + F.col("bin") * F.lit(float(width))).alias("low"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def near_counts(df: DataFrame, value: str, thresholds: list[float]) -> DataFrame:
    """Per threshold: sales at it, 1, up to 1000 and up to 5000 below it, the share just under, and the charm share."""
    x = df.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    v, t = F.col(value), F.col("threshold")
    x = x.where((v >= t - 50_000) & (v < t + 50_000))
    count = lambda c: F.count(F.when(c, 1))
    at, one = count(v == t), count(v == t - 1)
    return x.groupBy("threshold").agg(
        at.alias("at"), one.alias("one_below"), count((v < t) & (v >= t - 1000)).alias("within_1k"),
        count((v < t) & (v >= t - 5000)).alias("within_5k"),
        F.try_divide(count((v < t) & (v >= t - 5000)).cast("double"), F.count("*")).alias("just_under"),
        F.try_divide(one.cast("double"), one + at).alias("charm"),
    )


def spike_ratio(df: DataFrame, value: str, threshold: float, around: float, step: float = 10_000) -> Column | DataFrame:
    """Sales at or just below a threshold over the mean count of a same-width interval of non-round prices around it."""
    v = F.col(value)
    near = df.where((v >= threshold - around) & (v < threshold + around))
    spike = F.count(F.when((v > threshold - step) & (v <= threshold), 1))
    rest = F.count(F.when(F.pmod(v, F.lit(float(step))) != 0, 1)) * (step / (2 * around))
    return near.agg(spike.alias("spike"), F.try_divide(spike.cast("double"), rest).alias("ratio"))


def above_below(df: DataFrame, value: str, period: str, threshold: float, around: float) -> DataFrame:
    """Sales from the threshold over sales below it, by period."""
    v = F.col(value)
    above, below = F.count(F.when((v >= threshold) & (v < threshold + around), 1)), F.count(F.when((v < threshold) & (v >= threshold - around), 1))
    return df.groupBy(period).agg(above.alias("above"), below.alias("below"), F.try_divide(above.cast("double"), below).alias("ratio"))


def log_change(ratios: DataFrame, period: str, before: str, after: str) -> DataFrame:
    """The log of ``above_below``'s ratio after less before."""
    of = lambda p: F.log(F.max(F.when(F.col(period) == p, F.col("ratio"))))
    return ratios.agg((of(after) - of(before)).alias("log_change"))


def design(low: np.ndarray, threshold: float, half: float, width: float, degree: int, dummies: str | None, exact: str) -> np.ndarray:
    """Powers of the scaled distance and, if asked for, dummies of bins with round prices."""
    x = (low + width / 2 - threshold) / half
    columns = [x**k for k in range(degree + 1)]
    if dummies == "nested":
        near = np.round((low + width / 2) / width) * width
        columns += [(near % m == 0).astype(float) for m in (100_000, 50_000, 25_000)]
    elif dummies == "exclusive":
        high = low + width
        has = lambda k: np.floor(high / k) * k > low if exact == "below" else np.ceil(low / k) * k < high
        a, b, c = has(100_000), has(50_000), has(25_000)
        columns += [a.astype(float), (b & ~a).astype(float), (c & ~b).astype(float)]
    return np.column_stack(columns)


def counterfactual(
    low: np.ndarray, counts: np.ndarray, threshold: float, *, half: float, width: float, below: float = 50_000, above: float = 50_000,
    degree: int = 5, dummies: str | None = None, exact: str = "above",
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins' middles, which of them are in the band, and the polynomial's counts, fitted outside it."""
    middle = low + width / 2
    band = (middle > threshold - below) & (middle < threshold + above)
    x = design(low, threshold, half, width, degree, dummies, exact)
    return middle, band, x @ np.linalg.lstsq(x[~band], counts[~band], rcond=None)[0]


def fit_counts(low: np.ndarray, counts: np.ndarray, threshold: float, **parameters) -> dict[str, float]:
    """Excess below (``B``), missing above (``M``) and its share, against ``counterfactual``."""
    middle, band, fitted = counterfactual(low, counts, threshold, **parameters)
    under, over = band & (middle < threshold), band & (middle > threshold)
    missing, expected = (fitted[over] - counts[over]).sum(), fitted[over].sum()
    share = missing / expected if expected > 0 else np.nan
    return {"B": float((counts[under] - fitted[under]).sum()), "M": float(missing), "share": float(share), "n": int(counts.sum())}


def bunching(df: DataFrame, value: str, thresholds: list[float], *, half: float = 300_000, width: float = 10_000, groups: list[str] | None = None, exact: str = "above", **parameters) -> DataFrame:
    """``fit_counts`` at each threshold (and group): one aggregation to bins, then a small fit per threshold."""
    groups = groups or []
    v, t = F.col(value), F.col("threshold")
    x = df.withColumn("threshold", F.explode(F.array(*[F.lit(float(h)) for h in thresholds])))
    x = x.withColumn("v", F.when(v == t, t - 1e-6).otherwise(v) if exact == "below" else v)
    x = x.where((F.col("v") >= t - half) & (F.col("v") < t + half))
    counts = x.groupBy(*groups, "threshold", F.floor((F.col("v") - t + half) / width).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    size = int(round(2 * half / width))

    def fit(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        threshold, full = key[-1], np.zeros(size)
        full[part["bin"].to_numpy()] = part["n"].to_numpy()
        low = threshold - half + width * np.arange(size)
        found = fit_counts(low, full, threshold, half=half, width=width, exact=exact, **parameters)
        return pd.DataFrame([{**dict(zip([*groups, "threshold"], key, strict=True)), **found}])

    types = dict(df.dtypes)
    schema = ", ".join([*[f"{g} {types[g]}" for g in groups], "threshold double, B double, M double, share double, n long"])
    return counts.groupBy(*groups, "threshold").applyInPandas(fit, schema)


def bootstrap(df: DataFrame, value: str, threshold: float, draws: int, seed: int, *, half: float = 300_000, width: float = 10_000, **parameters) -> DataFrame:
    """``fit_counts`` on resampled bin counts: as only counts enter, a multinomial draw of them equals resampling sales."""
    rows = bins(df, value, threshold - half, threshold + half, width).orderBy("bin").collect()  # one row per bin
    low, counts = np.array([r["low"] for r in rows]), np.array([r["n"] for r in rows], dtype=float)

    def drawn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for draw in b["id"]:
                rng = np.random.default_rng([seed, int(draw)])
                c = rng.multinomial(int(counts.sum()), counts / counts.sum()).astype(float)
                out.append({"draw": draw, **fit_counts(low, c, threshold, half=half, width=width, **parameters)})
            yield pd.DataFrame(out)

    return df.sparkSession.range(draws).mapInPandas(drawn, "draw long, B double, M double, share double, n long")


def differences(
    df: DataFrame, value: str, threshold: float, cuts: dict[str, tuple[Column, Column]], draws: int, seed: int, *, half: float = 400_000, width: float = 10_000,
    below: float = 50_000, above: float = 100_000, high: tuple[float, float] = (0, 100_000), low: tuple[float, float] = (-150_000, -50_000), **parameters,
) -> DataFrame:
    """(cut, draw, pre, post, difference, log_ratio): bunching before and after, on resampled sales of both periods.

    ``cuts`` name pairs of conditions, the period before and the one after. ``pre`` and ``post`` are the shares missing
    above the threshold; ``log_ratio`` is the change in the log of sales in ``high`` over sales in ``low``, intervals
    from the threshold, which needs no polynomial. A null draw has the counts as they are. All of a period's sales are
    resampled, so a draw is multinomial over its bins and the rest.
    """
    for edge in (*high, *low, half):
        if edge % width or abs(edge) > half:
            raise ValueError(f"{edge} is not an edge of a bin of {width} within {half}")
    size, start = int(2 * half / width), threshold - half
    bin_ = F.when((F.col(value) >= start) & (F.col(value) < threshold + half), F.floor((F.col(value) - start) / width)).otherwise(size)
    sides = [F.when(c, F.lit(2 * i + k)) for i, cut in enumerate(cuts.values()) for k, c in enumerate(cut)]
    rows = df.where(F.col(value).isNotNull()).select(F.explode(F.array_compact(F.array(*sides))).alias("side"), bin_.cast("int").alias("bin"))
    counts = np.zeros((len(cuts), 2, size + 1))
    for r in rows.groupBy("side", "bin").count().collect():  # a row per period and bin
        counts[r["side"] // 2, r["side"] % 2, r["bin"]] = r["count"]
    lows, names = start + width * np.arange(size), list(cuts)
    inside = lambda x: slice(int((half + x[0]) / width), int((half + x[1]) / width))
    fixed = {"half": half, "width": width, "below": below, "above": above, **parameters}

    def found(pair: list[np.ndarray]) -> tuple:
        pre, post = (fit_counts(lows, c[:-1], threshold, **fixed)["share"] for c in pair)
        (ha, la), (hz, lz) = ((c[inside(high)].sum(), c[inside(low)].sum()) for c in pair)
        return pre, post, post - pre, float(np.log(hz / lz) - np.log(ha / la)) if min(ha, la, hz, lz) > 0 else np.nan

    def drawn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for cut, draw in zip(b["cut"], b["draw"], strict=True):
                pair = list(counts[cut])
                if draw >= 0:
                    rng = np.random.default_rng([seed, int(cut), int(draw)])
                    pair = [rng.multinomial(int(c.sum()), c / c.sum()).astype(float) if c.sum() else c for c in pair]
                out.append((names[cut], draw if draw >= 0 else None, *found(pair)))
            yield pd.DataFrame(out, columns=["cut", "draw", "pre", "post", "difference", "log_ratio"]).astype({"draw": "Int64"})

    jobs = df.sparkSession.range(len(cuts) * (draws + 1)).select(
        F.floor(F.col("id") / (draws + 1)).cast("int").alias("cut"), (F.col("id") % (draws + 1) - 1).alias("draw")
    )
    return jobs.mapInPandas(drawn, "cut string, draw long, pre double, post double, difference double, log_ratio double")


def difference_intervals(rows: DataFrame, column: str, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Per cut of ``differences``: the column's value on the counts as they are, and its percentile interval.

    Draws without a value (an empty interval) are left out; ``draws`` counts the others.
    """
    value = F.when(~F.isnan(column), F.col(column))
    drawn = F.when(F.col("draw").isNotNull(), value)
    return rows.groupBy("cut").agg(
        F.max(F.when(F.col("draw").isNull(), value)).alias(column), F.percentile(drawn, low).alias("low"), F.percentile(drawn, high).alias("high"),
        F.count(drawn).alias("draws"),
    )


def hole_extent(df: DataFrame, value: str, threshold: float, *, upto: float = 110_000, half: float = 500_000, width: float = 10_000, below: float = 50_000, above: float = 250_000, **parameters) -> DataFrame:
    """(low, n, fitted, ratio) of the bins from the threshold: how far above it sales are missing, under a wide band."""
    rows = bins(df, value, threshold - half, threshold + half, width).orderBy("bin").collect()  # one row per bin
    low, counts = np.array([r["low"] for r in rows]), np.array([r["n"] for r in rows], dtype=float)
    middle, _, fitted = counterfactual(low, counts, threshold, half=half, width=width, below=below, above=above, **parameters)
    at = np.flatnonzero((middle > threshold) & (middle < threshold + upto))
    out = [(float(low[i]), int(counts[i]), float(fitted[i]), float(counts[i] / fitted[i]) if fitted[i] else None) for i in at]
    return df.sparkSession.createDataFrame(out, "low double, n long, fitted double, ratio double")


def grid(df: DataFrame, value: str, threshold: float, *, degrees=(2, 3, 4, 5, 6, 7), below=(30_000, 50_000, 75_000, 100_000, 150_000), widths=(5_000, 10_000, 20_000, 25_000), halves=(150_000, 200_000, 300_000, 400_000, 500_000)) -> DataFrame:
    """``fit_counts`` over a grid of specifications whose band has 50,000 to spare and wide bins' edges; bins are counted once, at 5000."""
    step, widest = 5_000, max(halves)
    rows = bins(df, value, threshold - widest, threshold + widest, step).orderBy("bin").collect()  # one row per bin
    fine = np.array([r["n"] for r in rows], dtype=float)
    spark = df.sparkSession
    fits = lambda b, w, h: 2 * h % w == 0 and b < h - 50_000 and not (w in (20_000, 25_000) and b % w)
    cells = [(d, b, w, h) for d in degrees for b in below for w in widths for h in halves if fits(b, w, h)]

    def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            out = []
            for r in part.itertuples():
                first = int((widest - r.half) / step)
                counts = fine[first : len(fine) - first].reshape(-1, int(r.width / step)).sum(axis=1)
                low = threshold - r.half + r.width * np.arange(len(counts))
                found = fit_counts(low, counts, threshold, half=r.half, width=r.width, below=r.band, above=r.band, degree=r.degree)
                out.append({"degree": r.degree, "band": r.band, "width": r.width, "half": r.half, **found})
            yield pd.DataFrame(out)

    keys = "degree int, band double, width double, half double"
    given = spark.createDataFrame([(d, float(b), float(w), float(h)) for d, b, w, h in cells], keys)
    return given.mapInPandas(fitted, f"{keys}, B double, M double, share double, n long")


def minimum_detectable(draws: DataFrame, column: str = "M", factor: float = 2.8) -> DataFrame:
    """The smallest effect found with usual power: 2.80 standard deviations of the draws."""
    return draws.agg((F.stddev_samp(column) * factor).alias("mde"))
