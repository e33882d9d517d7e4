"""Small tables with everything that an operator must bear."""

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "Ünder lorem word%d ipsum. " * 3


def awkward(spark):
    """Nulls in every column, empty and white-space texts, a very long one, ties and repeated rows, clashing names."""
    long = " ".join(f"w{i % 977} x{i % 13}, Été{i % 31}.\n" for i in range(20_000))
    rows = [
        (1, "Plain words in a short text of some ten words or so.", "en", "a", 50), (2, "", "en", "a", 0), (3, None, "en", None, None),
        (None, "A row without id.", None, "b", 17), (None, None, None, None, None), (4, " \t\n ", "de", "b", 4), (5, long, "fr", "c", len(long)),
        (6, "same text", "en", "a", 9), (7, "same text", "en", "c", 9), (7, "same text", "en", "c", 9), (8, "ÄÖ ß 中文 🙂 ſ", None, "b", 10),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("size", "fp", "score", "component_id", "position", "copies", "h", "n", "weight", "target", "predicted", "__id"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def table(spark, name, sf="/root/testdata/sf0.001"):
    return spark.read.parquet(f"{sf}/{name}.parquet")
