"""The interval join between sales and filings over streams. An extension: the batch form is operators.linkage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def interval_join(sales: DataFrame, filings: DataFrame, *, key: str = "bbl", day: str = "sale_ts", filing_day: str = "doc_ts", before: int = 15, after: int = 180, late: str = "7 days") -> DataFrame:
    """Filings of a parcel within days of a sale; both sides forget rows that can no longer match."""
    s = sales.withWatermark(day, late)
    f = filings.select(F.col(key).alias(f"r_{key}"), F.col(filing_day)).withWatermark(filing_day, late)
    low = F.col(day) - F.expr(f"interval {before} days")
    high = F.col(day) + F.expr(f"interval {after} days")
    return s.join(f, (F.col(key) == F.col(f"r_{key}")) & F.col(filing_day).between(low, high)).drop(f"r_{key}")


def bucket_counts(events: DataFrame, ts: str, groups: list[str], width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Counts by group and time bucket, final once the watermark has passed the bucket."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), *groups).agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("start"), *groups, "n"
    )
