"""``python -m tenure``: list, run and render queries, with a manifest of inputs, stages and times.

    python -m tenure list
    python -m tenure run --sf DIR --out DIR [NAME ...]     all queries, or those named; results as Parquet
    python -m tenure render --out DIR [NAME ...]           tables from earlier results, nothing is computed again
"""

from __future__ import annotations

import argparse
import os


def session():
    from pyspark.sql import SparkSession

    os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")
    return SparkSession.builder.appName("tenure").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def render(spark, out: str, name: str, rows: int = 50) -> str:
    """A LaTeX table of a result's first rows in the order of its columns."""
    from tenure.sources.sinks import latex_table

    df = spark.read.parquet(f"{out}/{name}")
    return latex_table([tuple(r) for r in df.orderBy(*df.columns).limit(rows).collect()], df.columns)


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tenure", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("action", choices=("list", "run", "render"))
    parser.add_argument("names", nargs="*")
    parser.add_argument("--sf", help="folder of the input tables")
    parser.add_argument("--out", help="folder of the results; any file system that Spark knows")
    o = parser.parse_intermixed_args(args)
    from tenure.plans.catalogue import QUERIES

    names = o.names or sorted(QUERIES)
    if unknown := set(names) - set(QUERIES):
        parser.error(f"no such queries: {sorted(unknown)}")
    if o.action == "list":
        print("\n".join(names))
        return 0
    if not o.out or o.action == "run" and not o.sf:
        parser.error("--out is needed, and --sf to run")
    spark = session()
    if o.action == "render":
        for name in names:
            print(f"% {name}\n{render(spark, o.out, name)}")
        return 0
    from tenure.sources.sinks import Manifest, file_hashes

    manifest = Manifest({r["path"]: r["sha256"] for r in file_hashes(spark, o.sf).select("path", "sha256").collect()})
    try:
        for name in names:
            with manifest.stage(name):
                QUERIES[name](spark, o.sf).write.mode("overwrite").parquet(f"{o.out}/{name}")
    finally:  # what failed is in the manifest too
        rows = spark.createDataFrame([(manifest.text(),)], "value string")
        rows.coalesce(1).write.mode("overwrite").text(f"{o.out}/manifest")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
