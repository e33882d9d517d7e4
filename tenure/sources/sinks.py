"""Writers: delimited text, JSON, small rendered tables, macros, and the manifest of a run."""

from __future__ import annotations

import json
import re
from contextlib import contextmanager
from time import monotonic

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, *, gzip: bool = True, order: list[str] | None = None) -> None:
    out = df.sortWithinPartitions(*order) if order else df
    out.write.mode("overwrite").option("header", True).option("compression", "gzip" if gzip else "none").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_draws(draws: DataFrame, path: str) -> None:
    """Long-form draws or influences, the counterpart of a binary matrix file."""
    draws.write.mode("overwrite").parquet(path)


def result_json(result: dict) -> str:
    return json.dumps(result, indent=2, sort_keys=True, default=float)


def minus(text: str) -> str:
    """Hyphens in front of digits as mathematical minus signs."""
    return re.sub(r"(?<![\w.])-(?=\d)", r"$-$", text)


def latex_table(rows: list[tuple], header: list[str], *, digits: int = 2, align: str | None = None) -> str:
    """A tabular of a few collected rows."""
    cell = lambda v: "" if v is None else minus(f"{v:,.{digits}f}") if isinstance(v, float) else minus(str(v))
    lines = [" & ".join(map(cell, r)) + r" \\" for r in rows]
    spec = align or "l" + "r" * (len(header) - 1)
    return "\n".join([rf"\begin{{tabular}}{{{spec}}}", r"\toprule", " & ".join(header) + r" \\", r"\midrule", *lines, r"\bottomrule", r"\end{tabular}"])


def macros(values: dict[str, float | int | str], digits: int = 2) -> str:
    """One ``\\newcommand`` per value; names keep letters only, as the format asks."""
    text = lambda v: minus(f"{v:,.{digits}f}") if isinstance(v, float) else minus(f"{v:,}") if isinstance(v, int) else v
    return "\n".join(rf"\newcommand{{\{re.sub('[^A-Za-z]', '', n)}}}{{{text(v)}}}" for n, v in values.items())


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of the files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


class Manifest:
    """Inputs by hash, and stages with their seconds and status."""

    def __init__(self, inputs: dict[str, str] | None = None):
        self.inputs, self.stages = inputs or {}, []

    @contextmanager
    def stage(self, name: str):
        began = monotonic()
        try:
            yield
        except BaseException as e:
            self.stages.append({"name": name, "seconds": round(monotonic() - began, 2), "status": f"failed: {type(e).__name__}"})
            raise
        self.stages.append({"name": name, "seconds": round(monotonic() - began, 2), "status": "ok"})

    def text(self) -> str:
        return json.dumps({"inputs": self.inputs, "stages": self.stages}, indent=2)


def update_queue(queue: DataFrame, evidence: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """A working queue with the evidence's fields where it has them."""
    new = evidence.select(key, *[F.col(f).alias(f"__{f}") for f in fields])
    out = queue.join(new, key, "left")
    return out.withColumns({f: F.coalesce(f"__{f}", f) for f in fields}).drop(*[f"__{f}" for f in fields])
