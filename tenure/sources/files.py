"""Readers: delimited text, JSON arrays and maps, dated text, wide monthly tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, schema: str, *, partitions: int | None = None) -> DataFrame:
    """A delimited file with a header, gzip or not; a gzip file can't be split, so ``partitions`` deals its rows out."""
    df = spark.read.schema(schema).csv(path, header=True, enforceSchema=False, mode="PERMISSIVE")
    return df.repartition(partitions) if partitions else df


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that holds one JSON array of objects, gzip by its extension."""
    return spark.read.schema(schema).json(path, multiLine=True)


def read_ndjson(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_deed_map(spark: SparkSession, path: str) -> DataFrame:
    """(bbl, doc_date, document_id) of a JSON object {bbl: [[date, document], ...]}."""
    text = spark.read.text(path, wholetext=True)
    return flatten_map(text, "value")


def flatten_map(df: DataFrame, column: str, keep: list[str] | None = None) -> DataFrame:
    """Rows of a JSON map of arrays of pairs."""
    parsed = F.from_json(column, "map<string, array<array<string>>>")
    rows = df.select(*(keep or []), F.explode(parsed).alias("bbl", "pairs")).select(*(keep or []), "bbl", F.explode("pairs").alias("p"))
    return rows.select(*(keep or []), "bbl", F.substring(F.get("p", 0), 1, 10).try_cast("date").alias("doc_date"), F.get("p", 1).alias("document_id"))


def parse_rates(lines: DataFrame, number: str = "line_no", text: str = "line", *, document: str | None = None) -> DataFrame:
    """(observed, rate) of text in which a date line is followed by a line of average rates.

    A gap in the line numbers forgets the date. Texts are independent, by ``document``; repeated dates must agree.
    """
    keys = [document] if document else []
    order = Window.partitionBy(*keys).orderBy(number) if keys else Window.partitionBy(F.lit(0)).orderBy(number)  # one small text
    day = F.try_to_date(F.regexp_extract(text, r"^\s*([A-Z][a-z]+ \d{1,2}, \d{4})\s*$", 1), "MMMM d, yyyy")
    rate = F.regexp_extract(text, r"^\s*Average Rates\s*\|\s*([0-9.]+)\s*%", 1).try_cast("double")
    rows = lines.withColumns({"__day": day, "__rate": rate, "__new": (F.col(number) - F.lag(number).over(order) > 1).cast("int")})
    rows = rows.withColumn("__island", F.sum(F.coalesce("__new", F.lit(0))).over(order))
    inside = Window.partitionBy(*keys, "__island").orderBy(number)
    rows = rows.withColumn("observed", F.last("__day", ignorenulls=True).over(inside))
    found = rows.where(F.col("__rate").isNotNull() & F.col("observed").isNotNull())
    out = found.groupBy("observed").agg(F.min("__rate").alias("rate"), F.max("__rate").alias("other"))
    return out.select("observed", "rate", (F.col("rate") == F.col("other")).alias("consistent"))


def unpivot_months(wide: DataFrame, ids: list[str], first: str, last: str, name: str = "month", value: str = "level") -> DataFrame:
    """Long rows of a table with one column per YYYY-MM between two months, inclusive."""
    months = [c for c in wide.columns if len(c) == 7 and c[4] == "-" and first <= c <= last]
    long = wide.unpivot(ids, months, name, value)
    return long.where(F.col(value).isNotNull()).withColumn(name, F.to_date(F.concat(name, F.lit("-01"))))


def centred_log2(long: DataFrame, area: str, value: str, first: str, last: str, month: str = "month") -> DataFrame:
    """log2 of the value less the area's mean of it over fixed months."""
    log = F.log2(value)
    inside = F.col(month).between(first, last)
    return long.withColumn(f"{value}_log2", log - F.avg(F.when(inside, log)).over(Window.partitionBy(area)))
