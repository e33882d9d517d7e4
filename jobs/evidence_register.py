"""Job 2: the register of evidence texts, kept up to date as new files of documents arrive.

    python jobs/evidence_register.py --documents DIR --out DIR --checkpoint DIR [--config FILE]

Reviewers must not read a text twice, and want lenders and companies first. Each new document is entered with the SHA-256
of its text, the document that had this text first, who is named in it (lenders, companies, trusts), what a deed's cover
page says of its price, and the queue that follows: ``empty``, ``copy``, ``cover``, ``lender``, ``party`` or ``other``.

The documents are a file stream: a run takes the files that the checkpoint has not seen, in batches of
``files_per_batch``, and ends. A batch is written to ``register/batch=N`` as a whole, partitioned by queue, and its counts by
source to ``totals/batch=N``; a batch that was cut short is taken again under its number and replaced. So a run that failed
is run again, and a run without new files changes nothing. Checkpoint and register belong together.

``first_id`` is the smallest id among the first batch that has the text. Copies are found by their hashes: a row per new
hash is joined to the first entries of earlier batches, and back to the batch. Null, empty and white-space texts are in
the queue ``empty`` and never copies. Rows with a null id or source are entered too; repeated ids and rows as often as they
come. Names that a text has many times count once.
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

from tenure.functions import cover, names

log = logging.getLogger("jobs.evidence_register")

CONFIG = Path(__file__).with_suffix(".json")
ENTRY = """doc_id long, source string, text_sha256 string, n_bytes long, lender_high boolean, lender_broad boolean, company boolean, trust boolean,
    consideration double, first_id long"""
REGISTER = f"{ENTRY}, batch int, queue string"
TOTALS = "source string, queue string, documents long, bytes long, batch int"


def settings(path: str | Path = CONFIG) -> dict:
    return json.loads(Path(path).read_text())


def entries(documents: DataFrame, config: dict) -> DataFrame:
    """What a document alone says: no text leaves this step."""
    text = F.col(config["text"])
    blank = F.coalesce(F.trim(F.regexp_replace(text, r"\s+", "")), F.lit("")) == ""
    return documents.select(
        F.col(config["id"]).cast("long").alias("doc_id"), F.col(config["source"]).cast("string").alias("source"),
        F.when(~blank, F.sha2(text.cast("binary"), 256)).alias("text_sha256"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
        names.lender_high(text).alias("lender_high"), names.lender_broad(text).alias("lender_broad"), names.is_company(text).alias("company"),
        names.is_trust(text).alias("trust"), cover.parse_cover(text)["consideration"].alias("consideration"),
    )


def firsts(new: DataFrame, register: DataFrame | None) -> DataFrame:
    """(hash, first_id) of the batch's hashes: the entry of an earlier batch, or else the smallest id of this one."""
    own = new.where("text_sha256 is not null").groupBy("text_sha256").agg(F.min("doc_id").alias("own_id"))
    if register is None:
        return own.withColumnRenamed("own_id", "first_id")
    known = register.where("text_sha256 is not null and (queue <> 'copy')").groupBy("text_sha256").agg(F.min("first_id").alias("first_id"))
    return own.join(known, "text_sha256", "left").select("text_sha256", F.coalesce("first_id", "own_id").alias("first_id"))


def queue(seen_before: DataFrame) -> DataFrame:
    """The entries with their queue; rows of one id and text are one entry's and no copies."""
    copy = F.coalesce(F.col("first_id") != F.col("doc_id"), F.col("first_id").isNotNull())
    lender, party = F.col("lender_high") | F.col("lender_broad"), F.col("company") | F.col("trust")
    kind = F.when(F.col("text_sha256").isNull(), "empty").when(copy, "copy").when(F.col("consideration").isNotNull(), "cover")
    return seen_before.withColumn("queue", kind.when(lender, "lender").when(party, "party").otherwise("other"))


def read(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(REGISTER).parquet(f"{out}/register")


def enter(spark: SparkSession, batch: DataFrame, number: int, out: str, config: dict) -> None:
    """Write one batch. The entries are written first, by the stream's session; the rest is planned adaptively by ``spark``."""
    log.info("batch %d begins", number)
    entries(batch, config).write.mode("overwrite").parquet(f"{out}/staged")
    new = spark.read.parquet(f"{out}/staged")
    register = read(spark, out).where(F.col("batch") < number) if number else None
    done = queue(new.join(firsts(new, register), "text_sha256", "left"))
    columns = [*spark.createDataFrame([], ENTRY).columns, "queue"]
    done.select(*columns).hint("rebalance").write.mode("overwrite").partitionBy("queue").parquet(f"{out}/register/batch={number}")
    written = read(spark, out).where(F.col("batch") == number)
    totals = written.groupBy("source", "queue").agg(F.count("*").alias("documents"), F.sum("n_bytes").alias("bytes"))
    totals.coalesce(1).write.mode("overwrite").parquet(f"{out}/totals/batch={number}")
    log.info("batch %d: read and wrote %d documents to %s/register", number, written.count(), out)


def run(spark: SparkSession, documents: str, out: str, checkpoint: str, config: dict) -> DataFrame:
    """Enter all files that are new, wait for the end, and return the register as it stands."""
    out = out.rstrip("/")
    schema = spark.read.parquet(documents).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(documents)
    log.info("reads new files of %s", documents)
    started = stream.writeStream.foreachBatch(lambda batch, number: enter(spark, batch, number, out, config)).option("checkpointLocation", checkpoint)
    query = started.trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    register = read(spark, out)
    log.info("the register has %d documents", register.count())
    return register


def totals(spark: SparkSession, out: str) -> DataFrame:
    """Documents and bytes by source and queue over all batches."""
    rows = spark.read.schema(TOTALS).parquet(f"{out.rstrip('/')}/totals")
    return rows.groupBy("source", "queue").agg(F.sum("documents").alias("documents"), F.sum("bytes").alias("bytes"))


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("--documents", required=True, help="folder, or pattern of files, of documents as Parquet")
    parser.add_argument("--out", required=True, help="folder of register and totals")
    parser.add_argument("--checkpoint", required=True, help="folder of the stream's checkpoint")
    parser.add_argument("--config", default=CONFIG)
    o = parser.parse_args(args)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s: %(message)s")
    spark = SparkSession.builder.appName("evidence_register").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, o.documents, o.out, o.checkpoint, settings(o.config))
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
