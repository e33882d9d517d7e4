"""From raw documents to token files: five stages, each an operator of ``tenure.llm`` over all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. ``run`` writes every stage's result as Parquet in the
shared folder and reads it back as the next one's documents. All but the last return the columns of ``documents``:

1. quality_classifier drops the documents that the classifier rejects (score below 0.3);
2. near_duplicates keeps one document of each group, that with the smallest doc_id;
3. decontamination drops the documents that the contamination rule finds;
4. mixing returns a row per copy that the mix takes, so a document can come up to three times or not at all;
5. token_ids writes the token files and returns what reading them back tells; copies of a document stand side by side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tenure.llm import decontaminate, mixing, quality_classifier, simhash, token_files
from tenure.llm.common import materialize, table


#: Words that a worker of the last stage holds: half of what the operator alone does, as other stages' memory is still held.
WORDS = 400_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_files.round_trip(docs, words=WORDS)


STAGES = [
    ("quality_classifier", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mix),
    ("token_ids", token_ids),
]

#: SQL can't express the classifier, the components of fingerprints or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
