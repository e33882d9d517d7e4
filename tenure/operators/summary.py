"""Aggregates for tables and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenure.functions.measures import wilson

from .tables import written

#: Ranges of values into which a group is dealt for its percentiles.
RANGES = 256


def percentiles(df: DataFrame, value: str, shares: dict[str, float], groups: list[str]) -> DataFrame:
    """Exact percentiles by linear interpolation, a column a share: what ``F.percentile`` gives, without a group's values in one task.

    Values are counted by group, dealt by ranges (from a sketch, so ranges differ in size but nothing is lost), and each
    range's count tells in which the wanted ranks lie; only those ranges are put in order, each in a task. Groups without
    values have nulls. Null is a group of its own.
    """
    keys = [f"__g{i}" for i in range(len(groups) + 1)]  # one more, so that there is always a key
    rows = df.select(*[F.col(g).alias(k) for g, k in zip(groups, keys, strict=False)], F.lit(0).alias(keys[-1]), F.col(value).cast("double").alias("__v"))
    counts = written(rows.groupBy(*keys, "__v").agg(F.count("*").alias("__n")), "counts")
    known = counts.where("__v is not null")

    def beside(left: DataFrame, right: DataFrame, more: list[str] | None = None) -> DataFrame:
        own = right.select(*[F.col(k).alias(f"_{k}") for k in [*keys, *(more or [])]], *[c for c in right.columns if c not in [*keys, *(more or [])]])
        on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in [*keys, *(more or [])]]
        return left.join(own, on, "left").drop(*[f"_{k}" for k in [*keys, *(more or [])]])

    cuts = known.groupBy(*keys).agg(F.percentile_approx("__v", [(i + 1) / RANGES for i in range(RANGES - 1)], 10 * RANGES).alias("__cuts"))
    dealt = written(beside(known, cuts).withColumn("__range", F.size(F.filter("__cuts", lambda c: c < F.col("__v")))).drop("__cuts"), "dealt")
    sizes = dealt.groupBy(*keys, "__range").agg(F.sum("__n").alias("__size"))
    own = Window.partitionBy(*keys)  # a row a range
    sizes = sizes.withColumns({"__upto": F.sum("__size").over(own.orderBy("__range")), "__total": F.sum("__size").over(own)})
    place = [F.struct(F.lit(name).alias("name"), (F.lit(float(share)) * (F.col("__total") - 1)).alias("at")) for name, share in shares.items()]
    ranks = sizes.withColumn("w", F.explode(F.array(*place))).select(*keys, "__range", (F.col("__upto") - F.col("__size")).alias("__before"), "__upto", "w.name", "w.at")
    ranks = ranks.withColumn("rank", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at"))))).where("rank >= __before and rank < __upto").drop("__upto")
    asked = ranks.groupBy(*keys, "__range").agg(F.collect_list(F.struct("name", "at", "rank")).alias("__asked"), F.first("__before").alias("__before"))  # two a share
    lines = beside(dealt, asked, ["__range"]).where("__asked is not null")
    upto = F.sum("__n").over(Window.partitionBy(*keys, "__range").orderBy("__v")) + F.col("__before")
    lines = lines.withColumn("__end", upto).withColumn("a", F.explode("__asked")).where("a.rank >= __end - __n and a.rank < __end")
    low, high = F.min_by("__v", "a.rank"), F.max_by("__v", "a.rank")
    found = lines.groupBy(*keys, "a.name").agg((low + (high - low) * (F.first("a.at") - F.min("a.rank"))).alias("q"))
    wide = found.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == n, F.col("q"))).alias(n) for n in shares])
    return beside(counts.select(*keys).distinct(), wide).select(*[F.col(k).alias(g) for k, g in zip(keys, groups, strict=False)], *shares)


def with_percentiles(df: DataFrame, value: str, shares: dict[str, float], groups: list[str]) -> DataFrame:
    """Rows with their group's percentiles."""
    cut = percentiles(df, value, shares, groups).withColumnsRenamed({g: f"__of_{g}" for g in groups})
    if not groups:
        return df.crossJoin(F.broadcast(cut))  # one row
    return df.join(cut, [F.col(g).eqNullSafe(F.col(f"__of_{g}")) for g in groups]).drop(*[f"__of_{g}" for g in groups])


def profile(df: DataFrame, value: str, groups: list[str]) -> DataFrame:
    """Rows, quartiles and mean of a value by group."""
    rest = df.groupBy(*groups).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    cut = percentiles(df, value, {"p25": 0.25, "median": 0.5, "p75": 0.75}, groups).withColumnsRenamed({g: f"__of_{g}" for g in groups})
    on = [F.col(g).eqNullSafe(F.col(f"__of_{g}")) for g in groups]
    both = rest.join(cut, on) if groups else rest.crossJoin(F.broadcast(cut))  # one row each
    return both.select(*groups, "n", "p25", "median", "p75", "mean")


def mix(df: DataFrame, groups: list[str], columns: list[str]) -> DataFrame:
    """Rows and share of each level of the columns within the group: (groups, kind, level, n, share)."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("level")) for c in columns])).alias("e")
    counts = df.select(*groups, each).groupBy(*groups, "e.kind", "e.level").agg(F.count("*").alias("n"))
    totals = counts.groupBy(*groups, "kind").agg(F.sum("n").alias("total"))
    return counts.join(totals, [*groups, "kind"]).select(*groups, "kind", "level", "n", (F.col("n") / F.col("total")).alias("share"))


def shares(df: DataFrame, masks: dict[str, Column], groups: list[str]) -> DataFrame:
    """Share of rows for each mask by group (null for empty groups)."""
    return df.groupBy(*groups).agg(*[F.avg(F.coalesce(m, F.lit(False)).cast("double")).alias(n) for n, m in masks.items()])


def crosstab(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Counts of two labels; the columns are named ``<column>_<value>``."""
    wide = df.groupBy(row).agg(*[F.count(F.when(F.col(column) == v, 1)).alias(f"{column}_{v}".replace("-", "m")) for v in values])
    return wide


def audit_counts(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """One row: how many rows meet each condition."""
    return df.agg(*[F.count(F.when(c, 1)).alias(n) for n, c in conditions.items()])


def common_names(df: DataFrame, keys: list[str], name: str, n: int) -> DataFrame:
    """The n most frequent names over distinct (keys, name); ties in alphabetical order."""
    counts = df.where(F.col(name).isNotNull()).select(*keys, name).distinct().groupBy(name).count()
    return counts.orderBy(F.desc("count"), name).limit(n)


def transition_statistics(pairs: DataFrame, arm: str, y: str) -> DataFrame:
    """Mean growth, its standard error and the number of pairs by arm."""
    return pairs.groupBy(arm).agg(
        F.avg(y).alias("mean"), (F.stddev_samp(y) / F.sqrt(F.count(y))).alias("se"), F.count("*").alias("n")
    )


def half_difference(pairs: DataFrame, arm: str, y: str, groups: list[str] | None = None) -> DataFrame:
    """Half the difference of the switching arms' means, their sum, and z of the sum."""
    of = lambda k, f: f(F.when(F.col(arm) == k, F.col(y)))
    a, b = of("cf", F.avg), of("fc", F.avg)
    var = lambda k: F.pow(of(k, F.stddev_samp), 2) / F.nullif(of(k, F.count), F.lit(0))
    se = F.sqrt(var("cf") + var("fc"))
    out = pairs.groupBy(*(groups or []))
    return out.agg(
        ((a - b) / 2).alias("half_difference"), (a + b).alias("asymmetry"), F.try_divide(a + b, se).alias("z"),
        of("cf", F.count).alias("cf"), of("fc", F.count).alias("fc"),
    )


def cell_support(pairs: DataFrame, area: str, sides: dict[str, str], least: int = 5) -> DataFrame:
    """Area-year cells over both ends of the pairs: areas, cells, cells below ``least`` and the median cell."""
    ends = None
    for day in sides.values():
        own = pairs.select(F.col(area).alias("area"), F.year(day).alias("year"))
        ends = own if ends is None else ends.unionByName(own)
    cells = ends.groupBy("area", "year").count()
    return cells.agg(
        F.count_distinct("area").alias("areas"), F.count("*").alias("cells"), F.count(F.when(F.col("count") < least, 1)).alias("thin"),
        F.percentile("count", 0.5).alias("median"),
    )


def agreement(df: DataFrame, truth: str, rule: str, groups: list[str] | None = None) -> DataFrame:
    """Confusion of two 0/1 labels, the share that agrees and its Wilson interval, by group."""
    t, r = F.col(truth), F.col(rule)
    count = lambda c: F.count(F.when(c, 1))
    out = df.groupBy(*(groups or [])).agg(
        count((t == 1) & (r == 1)).alias("tp"), count((t == 0) & (r == 1)).alias("fp"),
        count((t == 1) & (r == 0)).alias("fn"), count((t == 0) & (r == 0)).alias("tn"),
    )
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    low, high = wilson(F.col("tp") + F.col("tn"), n)
    return out.withColumns({"agree": F.try_divide(F.col("tp") + F.col("tn"), n), "low": low, "high": high})


def weighted_error(df: DataFrame, error: str, weight: str) -> DataFrame:
    """Share of errors by weight, over strata of unequal sampling."""
    return df.agg(F.try_divide(F.sum(F.col(error) * F.col(weight)), F.sum(weight)).alias("error"), F.sum(weight).alias("weight"))
