"""Filters and masks: eligibility, cumulative specifications, trims, common support, guards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .pairing import weighted_quantile
from .summary import percentiles, with_percentiles


def eligible_sale(price: Column, day: Column, borough: Column, unit: Column | None = None) -> Column:
    """Price strictly inside 300k..6M, 2016 to 2025, not in borough 5, and (if given) a known unit."""
    ok = (price > 300_000) & (price < 6_000_000) & day.between("2016-01-01", "2025-12-31") & (borough != "5")
    return F.coalesce(ok & (unit != "") if unit is not None else ok, F.lit(False))


def headline(permit_free: Column, lender_high: Column, linked: Column) -> Column:
    return F.coalesce(permit_free & ~lender_high & linked, F.lit(False))


def cumulative(df: DataFrame, masks: dict[str, Column]) -> DataFrame:
    """A boolean per specification: its own mask and all before it."""
    out, seen = {}, F.lit(True)
    for name, mask in masks.items():
        seen = seen & F.coalesce(mask, F.lit(False))
        out[name] = seen
    return df.withColumns(out)


def drop_reasons(df: DataFrame, reasons: dict[str, Column]) -> DataFrame:
    """Rows with the first reason that drops them, null if none does; count or filter by it."""
    out = F.lit(None).cast("string")
    for name, bad in reversed(reasons.items()):
        out = F.when(F.coalesce(bad, F.lit(True)), F.lit(name)).otherwise(out)
    return df.withColumn("dropped", out)


def lot_kind(lot: Column) -> Column:
    """unit for condominium unit lots 1001 to 1999, house for 1 to 7499 otherwise."""
    return F.when(lot.between(1001, 1999), "unit").when(lot.between(1, 7499), "house")


def above_group_quantile(df: DataFrame, value: str, groups: list[str], share: float, exempt: int = 50) -> DataFrame:
    """Without each group's values below its quantile; groups of ``exempt`` rows or fewer stay whole."""
    out = with_percentiles(df, value, {"__cut": share}, groups).join(df.groupBy(*groups).agg(F.count("*").alias("__n")), groups)
    return out.where((F.col("__n") <= exempt) | (F.col(value) >= F.col("__cut"))).drop("__cut", "__n")


def common_support(df: DataFrame, value: str, group: str, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """Rows in the band from the largest low quantile of the groups to their smallest high one."""
    cuts = percentiles(df, value, {"l": low, "h": high}, [group])
    band = cuts.agg(F.max("l").alias("__l"), F.min("h").alias("__h"))
    return df.crossJoin(F.broadcast(band)).where(F.col(value).between(F.col("__l"), F.col("__h"))).drop("__l", "__h")  # one row


def terciles(df: DataFrame, value: str, group: str) -> DataFrame:
    """1, 2 or 3 by the group's 33.3 and 66.7 percentiles, each interval open above."""
    third = F.when(F.col(value) < F.col("__a"), 1).when(F.col(value) < F.col("__b"), 2).otherwise(3)
    return with_percentiles(df, value, {"__a": 0.333, "__b": 0.667}, [group]).withColumn("tercile", third).drop("__a", "__b")


def varying(df: DataFrame, key: str, flag: str) -> DataFrame:
    """Rows of keys with two rows at least whose flags differ."""
    sums = df.groupBy(F.col(key).alias("__key")).agg(F.sum(flag).alias("s"), F.count("*").alias("n"))
    keys = sums.where("n >= 2 and s > 0 and s < n").select("__key")
    return df.join(keys, F.col(key).eqNullSafe(F.col("__key")), "left_semi")


def trimmed(df: DataFrame, value: str, share: float) -> DataFrame:
    """Rows within the overall quantiles share and 1 - share, inclusive."""
    return with_percentiles(df, value, {"__l": share, "__h": 1 - share}, []).where(F.col(value).between(F.col("__l"), F.col("__h"))).drop("__l", "__h")


def trimmed_weighted(df: DataFrame, value: str, weight: str, low: float, high: float, group: str) -> DataFrame:
    """Rows within weighted quantiles of their group, inclusive."""
    q = weighted_quantile(df.select(group, value, weight), value, weight, [low, high], [group])
    cut = q.groupBy(group).agg(F.min("quantile").alias("__l"), F.max("quantile").alias("__h"))
    return df.join(cut, group).where(F.col(value).between(F.col("__l"), F.col("__h"))).drop("__l", "__h")


def without_top(df: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """Rows without the keys of the first ``n`` rows by an order: a top-n, then an anti-join."""
    top = df.orderBy(*order).limit(n).select(F.col(key).alias("__k"))
    return df.join(F.broadcast(top), F.col(key) == F.col("__k"), "left_anti")


def leave_one_out(df: DataFrame, column: str, values: list, *aggregates: Column) -> DataFrame:
    """Aggregates without each of the values in turn, from one pass."""
    out = F.explode(F.filter(F.array(*[F.lit(v) for v in values]), lambda v: v != F.col(column)))
    return df.withColumn("without", out).groupBy("without").agg(*aggregates)


def support_status(pairs: Column, cf: Column, fc: Column, least_pairs: int = 100, least_switches: int = 20) -> Column:
    """Whether a sample carries an estimate: a status, never an error."""
    return F.when(pairs < least_pairs, "too few pairs").when(F.least(cf, fc) < least_switches, "too few switchers").otherwise("ok")


def nested_violations(df: DataFrame, strict: str, base: str, wide: str) -> DataFrame:
    """How many rows break strict <= base <= wide (none should)."""
    bad = (F.col(strict) > F.col(base)) | (F.col(base) > F.col(wide))
    return df.agg(F.count(F.when(bad, 1)).alias("violations"), F.count("*").alias("rows"))


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, [F.coalesce(c, F.lit(False)) for c in conditions])


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in conditions])
