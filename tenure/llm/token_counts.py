"""Token counts as rollups that signed deltas keep up to date.

A rollup holds, by source, language and tokenizer version, how many documents and tokens there are. A batch of changes
is turned into signed rows: an insert adds its count, a delete takes away the count it carries, a revision takes away
the old count under its old keys and adds the new one. The batch's sums, one row per key, are written aside and renamed
to the batch's own name in one step. A batch whose name is there already is not applied again, so a replay after a
failure, by the same driver or another, changes nothing. ``compact`` folds the batches of one listing into a snapshot
that remembers their names; what is committed meanwhile isn't in that listing and stays a batch. Folded batches and the
snapshot before stay for one more compaction, as totals that were asked for before may be read later.

Sums are aggregated before the shuffle, so a source with a third of all rows sends one row per task.

Edge cases: null sources, languages and versions are keys like others; null counts add nothing but the document; null
ids are counted; rows that repeat are counted each; an empty batch is committed as one without rows; keys whose totals
have become zero are not listed. Other columns are not looked at.
"""

from __future__ import annotations

import re
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import token_files
from .common import WORD, bound_batches, materialize

KEYS = ("source", "lang", "tokenizer")
SCHEMA = "source string, lang string, tokenizer string, documents long, tokens long"
#: Versions of the counters that need no tokenizer file.
#: Separators are listed one by one: Java looks single ones up in a bit set, ranges one after another (35 times slower).
PLAIN = "".join(f"\\x{c:02X}" for c in range(0x80) if not chr(c).isalnum())
COUNTERS = {"words-1": WORD, "words-2": f"[^{PLAIN}]+"}


def count(text: Column, version: str) -> Column:
    """Tokens of a text by one of COUNTERS; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(COUNTERS[version])), F.lit(0)).cast("long")


def signed(changes: DataFrame) -> DataFrame:
    """Deltas of rows with ``op`` (insert, delete, revise), ``old`` and ``new``: structs of KEYS and ``n_tokens``."""
    side = lambda c, sign, ops: changes.where(F.col("op").isin(*ops)).select(f"{c}.*", F.lit(sign).alias("sign"))
    rows = side("new", 1, ("insert", "revise")).unionByName(side("old", -1, ("delete", "revise")))
    return rows.groupBy(*KEYS).agg(
        F.sum(F.col("sign")).cast("long").alias("documents"),
        F.sum(F.col("sign") * F.coalesce("n_tokens", F.lit(0))).cast("long").alias("tokens"),
    )


class Rollup:
    """The rollup below ``path``, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return sorted(x.getPath().getName() for x in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _rename(self, aside: str, name: str) -> bool:
        """Publish what was written aside; False, and nothing changes, if the name is taken."""
        target = self._path(name)
        self._fs.mkdirs(target.getParent())
        if self._fs.exists(target) or not self._fs.rename(self._path(aside), target):
            self._fs.delete(self._path(aside), True)
            return False
        nested = self._path(f"{name}/{aside.rsplit('/', 1)[-1]}")
        if self._fs.exists(nested):  # another driver published the name in between, and the folder moved into its own
            self._fs.delete(nested, True)
            return False
        return True

    def _listing(self) -> tuple[str | None, list[str]]:
        """The newest snapshot, and those of the batches' folders that it doesn't hold."""
        names = self._names("batches")  # before the snapshot: a folder that goes afterwards is held by the one then found
        snapshot = next(iter(self._names("snapshots")[::-1]), None)
        if snapshot and names:
            listed = self.spark.createDataFrame([(n,) for n in names], "batch string")
            held = {r[0] for r in self._held(snapshot).join(F.broadcast(listed), "batch", "left_semi").distinct().collect()}
            names = [n for n in names if n not in held]
        return snapshot, names

    def _held(self, snapshot: str) -> DataFrame:
        """Names of the batches in a snapshot."""
        return self.spark.read.schema("batch string").parquet(f"{self.path}/snapshots/{snapshot}/names")

    def committed(self, batch: str) -> bool:
        """Whether a batch of this name has been applied, compacted or not."""
        if self._fs.exists(self._path(f"batches/{batch}")):
            return True
        return any(self._held(s).where(F.col("batch") == batch).limit(1).count() for s in self._names("snapshots")[-1:])

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply a batch once; False if it has been applied before."""
        if not re.fullmatch(r"[A-Za-z0-9.-]+", batch):
            raise ValueError(f"not a name of a batch: {batch!r}")
        if self.committed(batch):
            return False
        aside = f"aside/{uuid.uuid4().hex}"
        signed(changes).write.parquet(f"{self.path}/{aside}")
        return self._rename(aside, f"batches/{batch}")

    def _sums(self, snapshot: str | None, names: list[str]) -> DataFrame:
        parts = [f"{self.path}/snapshots/{snapshot}/totals"] if snapshot else []
        parts += [f"{self.path}/batches/{b}" for b in names]
        rows = self.spark.read.schema(SCHEMA).parquet(*parts) if parts else self.spark.createDataFrame([], SCHEMA)
        sums = rows.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        return sums.where("documents <> 0 or tokens <> 0")

    def totals(self) -> DataFrame:
        """Totals by KEYS over the newest snapshot and the batches that it doesn't hold."""
        return self._sums(*self._listing())

    def compact(self) -> bool:
        """Fold the batches of one listing into a new snapshot; readers of either state see the same totals.

        Then what the snapshot before this one replaced is removed: the folders that it holds and the snapshots before it.
        False, and nothing changes, if another driver made the next snapshot in between.
        """
        (last, names), aside = self._listing(), f"aside/{uuid.uuid4().hex}"
        older = [b for b in self._names("batches") if b not in names] if last else []
        self._sums(last, names).write.parquet(f"{self.path}/{aside}/totals")
        own = self.spark.createDataFrame([(b,) for b in names], "batch string")
        (self._held(last).unionByName(own) if last else own).write.parquet(f"{self.path}/{aside}/names")
        if not self._rename(aside, f"snapshots/{int(last or -1) + 1:08d}"):
            return False
        if last:
            held = {r[0] for r in self._held(last).where(F.col("batch").isin(older)).collect()}  # not what came meanwhile
            for b in held:
                self._fs.delete(self._path(f"batches/{b}"), True)
            for s in self._names("snapshots"):
                if s < last:
                    self._fs.delete(self._path(f"snapshots/{s}"), True)
        return True


def life_cycle(documents: DataFrame, path: str) -> DataFrame:
    """Totals after the documents were loaded, recounted by the next version and cleared of those without tokens.

    The load and the recount are each sent twice, as after a lost acknowledgement.
    """
    spark = documents.sparkSession
    counts = documents.select("source", "lang", count(F.col("text"), "words-1").alias("a"), count(F.col("text"), "words-2").alias("b"))
    counts = materialize(counts)
    of = lambda c, version: F.struct("source", "lang", F.lit(version).alias("tokenizer"), F.col(c).alias("n_tokens"))
    none = F.lit(None).cast("struct<source:string,lang:string,tokenizer:string,n_tokens:bigint>")
    first, second = of("a", "words-1"), of("b", "words-2")
    load = counts.select(F.lit("insert").alias("op"), none.alias("old"), first.alias("new"))
    recount = counts.select(F.lit("revise").alias("op"), first.alias("old"), second.alias("new"))
    clear = counts.where("b = 0").select(F.lit("delete").alias("op"), second.alias("old"), none.alias("new"))
    rollup = Rollup(spark, path)
    for name, changes in (("load", load), ("load", load), ("recount", recount)):
        rollup.commit(name, changes)
    rollup.compact()
    for name, changes in (("recount", recount), ("clear", clear)):
        rollup.commit(name, changes)
    return rollup.totals()


def encoded(text: Column, tokenizer: str) -> Column:
    """Tokens of a text by op9's encoder, without an end mark; null has none."""

    @F.pandas_udf("long")
    def sizes(texts: pd.Series) -> pd.Series:
        ids = token_files.encoder(tokenizer).encode([x if isinstance(x, str) else None for x in texts])
        return pd.Series([len(x) // 4 for x in ids], dtype="int64")

    return sizes(text)


def by_version(documents: DataFrame, path: str, tokenizer: str, name: str = "bpe-1") -> DataFrame:
    """Totals of all documents, those without tokens too, by each of COUNTERS and by the tokenizer; a batch a version."""
    spark = documents.sparkSession
    bound_batches(spark)
    versions = {v: count(F.col("text"), v) for v in COUNTERS} | {name: encoded(F.col("text"), tokenizer)}
    counts = materialize(documents.select("source", "lang", *[c.alias(v) for v, c in versions.items()]))
    none = F.lit(None).cast("struct<source:string,lang:string,tokenizer:string,n_tokens:bigint>")
    rollup = Rollup(spark, path)
    for v in versions:
        new = F.struct("source", "lang", F.lit(v).alias("tokenizer"), F.col(v).alias("n_tokens"))
        rollup.commit(v, counts.select(F.lit("insert").alias("op"), none.alias("old"), new.alias("new")))
    return rollup.totals()
