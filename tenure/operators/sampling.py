"""Reproducible samples by hashes of keys: the same rows on any partitioning, in any engine with MD5."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_key(key: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) from the first 48 bits of the hash."""
    return (F.conv(F.substring(hash_key(key, seed), 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def stratified(df: DataFrame, key: str, strata: list[str], n: int, seed: int) -> DataFrame:
    """Up to ``n`` rows per stratum with the stratum's population, the probability and its inverse as weight.

    The sample is the feature: ``n`` rows are what is asked for.
    """
    # row_number <= n alone is pushed below the shuffle: a task sends n rows of a stratum at most
    first = F.row_number().over(Window.partitionBy(*strata).orderBy(hash_key(F.col(key), seed), key))
    out = df.withColumn("__r", first).where(F.col("__r") <= n).drop("__r")
    sizes = df.groupBy(*[F.col(s).alias(f"__{s}") for s in strata]).agg(F.count("*").alias("stratum_population"))
    same = [F.col(s).eqNullSafe(F.col(f"__{s}")) for s in strata]
    out = out.join(sizes, same).drop(*[f"__{s}" for s in strata])
    share = F.least(F.lit(n), F.col("stratum_population")) / F.col("stratum_population")
    return out.withColumns({"probability": share, "weight": 1 / share})


def additions(sample: DataFrame, targeted: DataFrame, key: str) -> DataFrame:
    """Sample and targeted rows that it lacks, told apart by ``sample_kind``."""
    extra = targeted.join(sample.select(key), key, "left_anti").withColumn("sample_kind", F.lit("targeted"))
    return sample.withColumn("sample_kind", F.lit("random")).unionByName(extra, allowMissingColumns=True)


def blinded(sample: DataFrame, key: str, seed: int, hidden: list[str], prefix: str = "H") -> tuple[DataFrame, DataFrame]:
    """(sheet, key table): rows in hash order with new ids, the sheet without the hidden columns."""
    order = Window.orderBy(hash_key(F.col(key), seed), key)  # a review sample: tens of rows
    out = sample.withColumn("case_id", F.format_string(f"{prefix}%03d", F.row_number().over(order)))
    return out.drop(*hidden), out.select("case_id", key, *hidden)


def weighted_without_replacement(df: DataFrame, key: str, weight: Column, n: int, seed: int) -> DataFrame:
    """``n`` rows drawn without replacement with chances by weight: the largest keys log(u) / w."""
    order = F.log(uniform(F.col(key), seed)) / weight
    return df.withColumn("draw_key", order).orderBy(F.desc("draw_key"), key).limit(n)
