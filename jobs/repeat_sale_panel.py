"""Job 1: the panel of repeat-sale pairs that estimation starts from, partitioned by borough and year of the second sale.

    python jobs/repeat_sale_panel.py --tables DIR --out DIR [--config FILE] [--years FIRST LAST]

Sales are marked as financed in each window of days around them, paired with the parcel's sale before, and given log
growth, arm, holding years, the weekly rate as of both days, and whether a permit was issued between them. Two tables are
written below ``--out``: ``panel``, and ``summary`` with pairs and mean growth per borough, year and arm, made from the panel
as written.

A run replaces both tables. With ``--years`` only pairs whose second sale lies in these years are made, from sales up to
the last of them, and only their partitions are replaced; a year that has lost all its pairs keeps its old partition until
the next full run. The result depends on the tables and the configuration alone, so a run that was stopped is run again.

Rows without a parcel or a day take part in no pair. Empty tables give empty ones. Hot parcels are paired by periods
(``spread``), hot boroughs are split over files by the rebalanced write.
"""

from __future__ import annotations

import argparse
import json
import logging
import sys
from pathlib import Path

if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenure.functions import measures
from tenure.operators import linkage, pairing
from tenure.plans.registry import Tables

log = logging.getLogger("jobs.repeat_sale_panel")

CONFIG = Path(__file__).with_suffix(".json")
PANEL = """bbl string, zipcode string, src string, sale_id_a long, sale_id_z long, date_a date, date_z date, price_a double, price_z double,
    financed_strict_a int, financed_strict_z int, financed_base_a int, financed_base_z int, financed_wide_a int, financed_wide_z int,
    growth double, arm string, years double, rate_a double, rate_z double, permit boolean, borough string, year int"""
SUMMARY = "arm string, pairs long, mean_growth double, mean_years double, permits long, borough string, year int"


def settings(path: str | Path = CONFIG) -> dict:
    return json.loads(Path(path).read_text())


def panel(tables: Tables, config: dict, years: tuple[int, int] | None = None) -> DataFrame:
    """The pairs with all that the panel says of them."""
    sales = tables.sales.where("bbl is not null and sale_date is not null")
    if years:
        sales = sales.where(F.col("sale_date") <= F.make_date(F.lit(years[1]), F.lit(12), F.lit(31)))
    windows = {name: tuple(days) for name, days in config["windows"].items()}
    flagged = linkage.window_flags(sales, tables.filings, windows)
    kept = ["sale_id", "sale_date", "price", *[f"financed_{name}" for name in windows]]
    pairs = pairing.consecutive(
        flagged, "bbl", ["sale_date", "sale_id"], carry=kept, same=["borough", "zipcode", "src"], hold=config["hold_days"], day="sale_date",
        spread=config["spread"],
    )
    pairs = pairs.withColumnsRenamed({"sale_date_a": "date_a", "sale_date_z": "date_z"}).withColumn("year", F.year("date_z"))
    if years:
        pairs = pairs.where(F.col("year").between(*years))
    label = f"financed_{config['label']}"
    pairs = linkage.flag_between(pairs, tables.permits, "bbl", "date_a", "date_z", "issued", "permit")
    weekly = tables.rates
    rates = pairs.sparkSession.createDataFrame(weekly.toArrow(), weekly.schema)  # a row a week, made once for both days
    for side in ("a", "z"):
        pairs = linkage.as_of(pairs, rates, f"date_{side}", "observed", "rate").withColumnRenamed("rate", f"rate_{side}")
    return pairs.withColumns(
        {
            "growth": measures.log_growth(F.col("price_a"), F.col("price_z")),
            "arm": measures.arm(F.col(f"{label}_a"), F.col(f"{label}_z")),
            "years": F.datediff("date_z", "date_a") / 365.25,
        }
    )


def write(df: DataFrame, path: str, schema: str, whole: bool) -> DataFrame:
    """Write partitions of borough and year, all of them or those that ``df`` has, and read the table back."""
    spark = df.sparkSession
    columns = spark.createDataFrame([], schema).columns
    dealt = df.select(*columns).hint("rebalance", "borough", "year")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "static" if whole else "dynamic").partitionBy("borough", "year").parquet(path)
    out = spark.read.schema(schema).parquet(path)
    log.info("wrote %s: %d rows in all", path, out.count())
    return out


def run(spark: SparkSession, tables: str, out: str, config: dict, years: tuple[int, int] | None = None) -> DataFrame:
    """Make both tables below ``out`` and return the panel as it stands."""
    source = Tables(spark, tables.rstrip("/"))
    for name in ("orders", "customer", "nation", "lineitem"):
        log.info("read %s/%s.parquet: %d rows", source.sf_dir, name, getattr(source, name).count())
    out = out.rstrip("/")
    made = write(panel(source, config, years), f"{out}/panel", PANEL, whole=years is None)
    own = made if years is None else made.where(F.col("year").between(*years))
    means = [F.avg("growth").alias("mean_growth"), F.avg("years").alias("mean_years"), F.count_if("permit").alias("permits")]
    write(own.groupBy("borough", "year", "arm").agg(F.count("*").alias("pairs"), *means), f"{out}/summary", SUMMARY, whole=years is None)
    return made


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("--tables", required=True, help="folder of the input tables")
    parser.add_argument("--out", required=True, help="folder of the results")
    parser.add_argument("--config", default=CONFIG)
    parser.add_argument("--years", nargs=2, type=int, metavar=("FIRST", "LAST"))
    o = parser.parse_args(args)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s: %(message)s")
    spark = SparkSession.builder.appName("repeat_sale_panel").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, o.tables, o.out, settings(o.config), tuple(o.years) if o.years else None)
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
