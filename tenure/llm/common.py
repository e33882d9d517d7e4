"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word of the contracts that split on ASCII white space; Java looks single characters up in a bit set, a range not.
WORD = r"[^\x20\x09\x0A\x0B\x0C\x0D]+"
ARROW_ROWS = 500
#: Small sides up to this many rows may be broadcast; beyond it a salted shuffle join is used.
BROADCAST_ROWS = 200_000
#: ... if their strings and arrays take up to this many bytes.
BROADCAST_BYTES = 64 << 20


def bound_batches(spark: SparkSession) -> None:
    """Hold Arrow batches to ARROW_ROWS rows and so a worker's memory to some MB of text; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir, which driver and executors share.

    Only where the session names none (tests, notebooks) a local one is set, and removed when the driver ends. In a
    shared folder tables stay until its own retention removes them, as results may be read lazily.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            base = known.get()
        else:
            base = tempfile.mkdtemp(prefix="tenure-")
            atexit.register(shutil.rmtree, base, ignore_errors=True)
            spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/tenure-{uuid.uuid4().hex}"


def materialize(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts the lineage: a lost executor afterwards costs a re-read, not a recomputation.
    """
    bound_batches(df.sparkSession)
    path = path or shared_dir(df.sparkSession)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_small(
    big: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "left", rows: int | None = None, salts: int = 16
) -> DataFrame:
    """Join a large side to one that is expected to be small, without trusting that it is.

    ``small`` is broadcast if it has at most BROADCAST_ROWS rows (``rows``, if its columns are short, or else counted
    here) of BROADCAST_BYTES in all; otherwise it is replicated ``salts`` times and joined by (keys, salt), so that a key
    with a third of all rows is dealt over ``salts`` tasks. Keys are compared null-safe. Columns of the same name keep those
    of ``big``.
    """
    if rows is None:
        rows, size = small.agg(F.count("*"), F.sum(_bytes(small))).first()
        rows = rows if (size or 0) <= BROADCAST_BYTES else BROADCAST_ROWS + 1
    renamed = small.select(
        *[F.col(k).alias(f"__k_{k}") for k in keys], *[c for c in small.columns if c not in keys and c not in big.columns]
    )
    cond = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]
    if rows <= BROADCAST_ROWS:
        out = big.join(F.broadcast(renamed), cond, how)
    else:
        salted = renamed.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        left = big.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
        out = left.join(salted, [*cond, F.col("__salt") == F.col("__s")], how).drop("__s", "__salt")
    return out.drop(*[f"__k_{k}" for k in keys])


def numbered(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with ``__nth``: their number among the rows of their keys, without a task that holds all of them.

    The rows are written down, as their numbers must not change when a task is run again.
    """
    n = F.monotonically_increasing_id()
    rows = materialize(rows.withColumns({"__part": F.shiftright(n, 33).cast("int"), "__k": n}))
    own = [*keys, "__part"]
    parts = rows.groupBy(*own).agg(F.count("*").alias("__c"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row a task
    parts = materialize(parts.select(*own, F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__before")))
    nth = F.row_number().over(Window.partitionBy(*own).orderBy("__k"))
    rows = join_small(rows.withColumn("__nth", nth), parts, own)
    return rows.withColumn("__nth", F.col("__before") + F.col("__nth") - 1).drop("__part", "__k", "__before")


def _bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes."""
    total = F.lit(8 * len(df.columns))
    for c, t in df.dtypes:
        if t in ("string", "binary"):
            total = total + F.coalesce(F.octet_length(c), F.lit(0))
        elif t.startswith("array"):
            total = total + 16 * F.greatest(F.size(c), F.lit(0))
    return total


def n_words(text: Column) -> Column:
    """Words split by ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out. A null id is in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5, F.lit(0)).cast("int")
