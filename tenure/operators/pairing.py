"""Sequences within a parcel: consecutive pairs, flips, rolling counts, gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import scanned


def numbered(rows: DataFrame, key: str, order: list[str], number: str = "n_sale", total: str = "n_sales_total") -> DataFrame:
    """Rows with their number within the key and the key's number of rows, by a scan in two levels."""
    return scanned(rows, [key], order, number=number, total=total)


def consecutive(
    rows: DataFrame, key: str, order: list[str], *, carry: list[str], day: str, hold: int, same: list[str] | None = None, spread: str | None = None
) -> DataFrame:
    """Pairs of neighbouring rows that lie ``hold`` days apart at least.

    The filter comes after pairing: a pair that is too short is dropped and does not join its neighbours. ``carry``
    columns come twice, with ``_a`` and ``_z``; ``same`` columns once, from the second row. ``order`` begins with the
    day. With ``spread`` (year, month, ...) a key's rows are dealt by that period, so that a key with a third of all rows
    takes many tasks: neighbours are found within periods, and a period's first row takes the last of the one before.
    """
    item = F.struct(*carry)
    if spread is None:
        out = rows.withColumn("__a", F.lag(item).over(Window.partitionBy(key).orderBy(*order)))
    else:
        within = Window.partitionBy(key, "__p").orderBy(*order)
        rows = rows.withColumn("__p", F.trunc(day, spread))
        rows = rows.withColumns({"__in": F.lag(item).over(within), "__end": F.lead(F.lit(True)).over(within).isNull()})
        # the first and the last of each period stand together, two rows per key and period
        inner = F.when(F.col("__in").isNotNull() & ~F.col("__end"), F.col("__p"))
        before = F.lag(item).over(Window.partitionBy(key, "__inner").orderBy(*order))
        out = rows.withColumn("__inner", inner).withColumn("__a", F.coalesce("__in", before))
    out = out.where(F.datediff(F.col(day), F.col(f"__a.{day}")) >= hold)
    ends = [x for c in carry for x in (F.col(f"__a.{c}").alias(f"{c}_a"), F.col(c).alias(f"{c}_z"))]
    return out.select(key, *(same or []), *ends)


def drop_flips(rows: DataFrame, key: str, order: list[str], day: str, shortest: int, longest: int | None = None) -> DataFrame:
    """Rows whose gap to the row before, dropped or not, is long enough (and not too long); the first always stays."""
    gap = F.datediff(F.col(day), F.col("__before"))
    ok = gap.isNull() | (gap >= shortest if longest is None else gap.between(shortest, longest))
    return scanned(rows, [key], order, previous={"__before": day}).where(ok).drop("__before")


def rolling_count(rows: DataFrame, key: str, day: str, around: int, name: str, where: Column | None = None, *, spread: bool = False) -> DataFrame:
    """Rows of the key within ``around`` days, the row itself included.

    With ``spread`` a key's rows are dealt by periods somewhat longer than the frame, each seen by its neighbours too,
    so that a key with a third of all rows takes many tasks.
    """
    counted = F.count(F.when(where, 1) if where is not None else F.lit(1))
    if not spread:
        return rows.withColumn(name, counted.over(Window.partitionBy(key).orderBy(F.unix_date(day)).rangeBetween(-around, around)))
    width = max(4 * around, 30)
    at = F.unix_date(day)
    period = lambda d: F.floor(d / width)
    rows = rows.withColumn("__p", F.explode(F.array_distinct(F.array(period(at - around), period(at), period(at + around)))))
    w = Window.partitionBy(key, "__p").orderBy(at).rangeBetween(-around, around)
    return rows.withColumn(name, counted.over(w)).where(F.col("__p") == period(at)).drop("__p")


def gaps(rows: DataFrame, day: str, longest: int, keys: list[str] | None = None) -> DataFrame:
    """Steps of a date series that are longer than ``longest`` days.

    Without keys the series is cut at quarters, with each quarter's first day carried along, so no task holds it all.
    """
    keys = keys or []
    rows = rows.select(*keys, day).distinct()
    quarter = F.trunc(day, "quarter")
    inside = F.lead(day).over(Window.partitionBy(*keys, "__q").orderBy(day))
    firsts = rows.groupBy(*keys, quarter.alias("__q")).agg(F.min(day).alias("__first"))
    # one row per quarter: a short series by nature
    firsts = firsts.withColumn("__next", F.lead("__first").over(Window.partitionBy(*keys).orderBy("__q"))).drop("__first")
    out = rows.withColumn("__q", quarter).withColumn("__in", inside).join(firsts, [*keys, "__q"])
    step = F.coalesce("__in", "__next")
    return out.where(F.datediff(step, F.col(day)) > longest).select(*keys, day, step.alias("next"), F.datediff(step, F.col(day)).alias("days"))


def dense_codes(rows: DataFrame, column: str, name: str) -> DataFrame:
    """Rows with a code from 0 by the sorted distinct values: numbered once over the values, in ranges, not over the rows.

    Null has no code: its rows are left out.
    """
    values = scanned(rows.select(column).where(F.col(column).isNotNull()).distinct(), [], [column], number=name)
    return rows.join(values.withColumn(name, F.col(name) - 1), column)


def first_per(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by an explicit order."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__n", nth).where("__n = 1").drop("__n")


def two_sale_switchers(rows: DataFrame, key: str, order: list[str], flag: str) -> DataFrame:
    """Keys with exactly two rows whose flags differ, as one row with both ends' flags."""
    w = Window.partitionBy(key)
    out = rows.withColumns({"__n": F.count("*").over(w), f"{flag}_a": F.lag(flag).over(w.orderBy(*order))})
    return out.where((F.col("__n") == 2) & F.col(f"{flag}_a").isNotNull() & (F.col(f"{flag}_a") != F.col(flag))).drop("__n")


def demeaned(rows: DataFrame, columns: list[str], group: str, weight: str | None = None) -> DataFrame:
    """Columns less their mean in the group, as ``<column>_within``.

    Means are summed before the shuffle and joined back, so no task holds a group.
    """
    mean = lambda c: F.avg(c) if weight is None else F.sum(F.col(c) * F.col(weight)) / F.sum(weight)
    means = rows.groupBy(F.col(group).alias("__group")).agg(*[mean(c).alias(f"__mean_{c}") for c in columns])
    out = rows.join(means, F.col(group).eqNullSafe(F.col("__group")))
    return out.withColumns({f"{c}_within": F.col(c) - F.col(f"__mean_{c}") for c in columns}).drop("__group", *[f"__mean_{c}" for c in columns])


def hold_sweep(pairs: DataFrame, days: str, holds: list[int], *aggregates: Column) -> DataFrame:
    """Aggregates of the pairs that pass each minimum hold, from one pass."""
    each = F.explode(F.filter(F.array(*[F.lit(h) for h in holds]), lambda h: F.col(days) >= h))
    return pairs.withColumn("hold", each).groupBy("hold").agg(*aggregates)


#: Ranges of values into which a group is dealt.
RANGES = 64


def weighted_cdf(rows: DataFrame, value: str, weight: str, keys: list[str]) -> DataFrame:
    """Rows with ``cdf``: (weight up to and with the row, less half its own) over the group's weight.

    A group is dealt by ranges of its values: the ranges' sums are accumulated, then the rows within each.
    """
    shares = [(i + 1) / RANGES for i in range(RANGES - 1)]
    cuts = rows.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(
        F.percentile_approx(F.col(value).cast("double"), shares, 1000).alias("__cuts"), F.sum(weight).alias("__total")
    )
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    ranged = F.size(F.filter("__cuts", lambda c: c < F.col(value))).alias("__range")
    dealt = rows.join(cuts, same).select(*rows.columns, "__total", F.when(F.col(value).isNull(), -1).otherwise(ranged).alias("__range"))
    sums = dealt.groupBy(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__range").alias("__r")).agg(F.sum(weight).alias("__sum"))
    before = Window.partitionBy(*[f"__{k}" for k in keys]).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    sums = sums.withColumn("__before", F.coalesce(F.sum("__sum").over(before), F.lit(0))).drop("__sum")
    dealt = dealt.join(sums, [*same, F.col("__range") == F.col("__r")])
    inside = F.sum(weight).over(Window.partitionBy(*keys, "__range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.select(*rows.columns, ((F.col("__before") + inside - F.col(weight) / 2) / F.col("__total")).alias("cdf"))


def weighted_quantile(rows: DataFrame, value: str, weight: str, shares: list[float], keys: list[str]) -> DataFrame:
    """Quantiles by linear interpolation of the weighted distribution, flat beyond its ends."""
    c = weighted_cdf(rows.where(F.col(weight) > 0), value, weight, keys)
    c = c.select(*keys, "cdf", F.col(value).alias("__v"), F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share"))
    point, below = F.struct("cdf", F.col("__v").alias("v")), F.col("cdf") <= F.col("share")
    near = c.groupBy(*keys, "share").agg(F.max(F.when(below, point)).alias("a"), F.min(F.when(~below, point)).alias("b"))
    between = F.col("a.v") + (F.col("b.v") - F.col("a.v")) * (F.col("share") - F.col("a.cdf")) / (F.col("b.cdf") - F.col("a.cdf"))
    return near.select(*keys, "share", F.coalesce(between, "a.v", "b.v").alias("quantile"))
