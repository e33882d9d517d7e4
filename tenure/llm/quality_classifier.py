"""Quality classifier: random Fourier features, ridge by summed normal equations, isotonic calibration.

The score of a text depends on its statistics alone. Features are mapped by ``cos(xW + b)`` to an approximation of
a Gaussian kernel's feature space; each partition sums ``Z'Z`` and ``Z'y`` per fold, and only these sums, whose size
doesn't depend on the data, reach the driver. As the sums are additive, the equations without one fold are those of
all folds less that fold's, so out-of-fold scores for the calibration cost no further pass over the documents.

Edge cases: null and empty texts have all statistics at zero and get a score like any other; repeated rows are scored
each; an empty table gives an empty result; labels of one class only (or none) give the constant score of their mean
(or 0.5). Null labels and null ids are not learned from. Other columns of the input are not looked at.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold, materialize

SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
DIGITS = b"0123456789"
FEATURES = (
    "log_words", "word_length", "symbols", "pipes", "marks", "upper", "digits", "distinct", "most_frequent",
    "adjacent_repeats", "repeated_lines", "log_line_words", "short_words", "stops", "ended_lines",
)


def statistics(text: str | None) -> list[float]:
    """The features of one whole text, in the order of FEATURES."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    chars = sum(map(len, words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    lower = [w.strip(b".,;:!?|#*$%&<>()\"'") for w in raw.lower().split()]
    counts = Counter(lower)
    count = lambda which: len(raw) - len(raw.translate(None, which))
    return [
        math.log1p(n),
        chars / n,
        math.log1p(10 * count(SYMBOLS) / n),
        math.log1p(10 * raw.count(b"|") / n),
        math.log1p(10 * raw.count(b"!") / n),
        count(UPPER) / chars,
        count(DIGITS) / chars,
        len(counts) / n**0.9,
        counts.most_common(1)[0][1] / (n + 5),
        sum(map(bytes.__eq__, lower, lower[1:])) / n,
        1 - len(set(lines)) / len(lines),
        math.log(n / len(lines)),
        sum(len(w) <= 3 for w in lower) / n,
        math.log1p(10 * count(b".,;:?") / n),
        sum(x.rstrip()[-1:] in b".!?" for x in lines) / len(lines),
    ]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def statistics_of(texts: pd.Series) -> pd.Series:
    return pd.Series([statistics(t) for t in texts])


@dataclass
class Model:
    """What a fit leaves; its size depends on the parameters alone."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    phases: np.ndarray
    coefficients: np.ndarray
    knots: np.ndarray
    values: np.ndarray
    constant: float | None = None

    def lift(self, x: np.ndarray) -> np.ndarray:
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        z = np.cos(x @ self.weights + self.phases) * math.sqrt(2 / len(self.phases))
        return np.hstack([z, x / 6, np.ones((len(x), 1))])

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Calibrated scores; a hundredth of the raw score keeps the order within a calibration step."""
        if self.constant is not None:
            return np.full(len(x), self.constant)
        raw = self.lift(x) @ self.coefficients
        return np.clip(0.99 * np.interp(raw, self.knots, self.values) + 0.01 * np.clip(raw, 0, 1), 0, 1)


def isotonic(x: np.ndarray, n: np.ndarray, positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over points sorted by x; knots and values of the blocks."""
    blocks: list[list[float]] = []
    for point in zip(x * n, n, positive, strict=True):
        blocks.append(list(point))
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    b = np.array(blocks)
    return b[:, 0] / b[:, 1], b[:, 2] / b[:, 1]


def fit(
    documents: DataFrame,
    labels: DataFrame,
    *,
    label: str = "quality",
    max_rows: int = 100_000,
    dimensions: int = 256,
    gamma: float = 0.08,
    ridge: float = 1e-3,
    bins: int = 2000,
    seed: int = 11,
) -> Model:
    """Fit on the labelled documents outside fold 0.

    At most about ``max_rows`` labels are used, chosen by a hash of their id; that bound makes the broadcast of ids
    and the features that are kept between the two passes independent of the corpus.
    """
    known = labels.select(F.col("doc_id").alias("__id"), F.col(label).cast("double").alias("__y")).where(
        F.col("__y").isNotNull() & F.col("__id").isNotNull() & (fold(F.col("__id")) != 0)
    )
    total = known.count()
    if total > max_rows:
        known = known.where(F.pmod(F.xxhash64("__id"), F.lit(1 << 30)) < F.lit(int((1 << 30) * max_rows / total)))
    rows = documents.select(F.col("doc_id").alias("__doc"), "text").join(F.broadcast(known), F.col("__doc") == F.col("__id"))
    rows = materialize(rows.select(fold(F.col("__id")).alias("fold"), "__y", statistics_of("text").alias("x")))
    d = len(FEATURES)
    moments = rows.agg(
        F.count("*").alias("n"), F.sum("__y").alias("y"),
        *[f(F.col("x")[i]).alias(f"{k}{i}") for i in range(d) for k, f in (("m", F.avg), ("s", F.stddev_pop))],
    ).first()
    n, y = moments["n"], moments["y"] or 0.0
    rng = np.random.RandomState(seed)
    model = Model(
        mean=np.array([moments[f"m{i}"] or 0.0 for i in range(d)]),
        scale=np.array([moments[f"s{i}"] or 1.0 for i in range(d)]),
        weights=rng.normal(scale=math.sqrt(2 * gamma), size=(d, dimensions)),
        phases=rng.uniform(0, 2 * math.pi, dimensions),
        coefficients=np.zeros(0), knots=np.zeros(0), values=np.zeros(0),
    )
    if not n or y in (0, n):
        model.constant = y / n if n else 0.5
        return model
    k = dimensions + d + 1

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            folds = batch["fold"].to_numpy()
            z = model.lift(np.stack(batch["x"].to_numpy()))
            zy = np.hstack([z, batch["__y"].to_numpy()[:, None]])
            for f in np.unique(folds):
                parts[f] = parts.get(f, 0) + z[folds == f].T @ zy[folds == f]
        for f, m in parts.items():
            yield pd.DataFrame({"fold": f, "i": range(k), "v": list(m)})

    def total_of(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"fold": [key[0]], "i": [key[1]], "v": [np.sum(np.stack(group["v"].to_numpy()), axis=0)]})

    schema = "fold int, i int, v array<double>"
    equations: dict[int, np.ndarray] = {}
    for r in rows.mapInPandas(sums, schema).groupBy("fold", "i").applyInPandas(total_of, schema).collect():
        equations.setdefault(r["fold"], np.zeros((k, k + 1)))[r["i"]] = r["v"]
    everything = sum(equations.values())

    def solve(m: np.ndarray) -> np.ndarray:
        penalty = ridge * max(m[k - 1, k - 1], 1.0) / 10 * np.eye(k)
        penalty[k - 1, k - 1] = 1e-9
        return np.linalg.solve(m[:, :k] + penalty, m[:, k])

    model.coefficients = solve(everything)
    without = {f: solve(everything - m) if len(equations) > 1 else model.coefficients for f, m in equations.items()}

    def histogram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            z = model.lift(np.stack(batch["x"].to_numpy()))
            b = np.stack([without[f] for f in batch["fold"]])
            raw = np.clip((z * b).sum(axis=1), -1, 2)
            yield pd.DataFrame({"bin": np.floor((raw + 1) / 3 * bins).astype(int), "raw": raw, "y": batch["__y"]})

    found = (
        rows.mapInPandas(histogram, "bin int, raw double, y double")
        .groupBy("bin").agg(F.avg("raw").alias("raw"), F.count("*").alias("n"), F.sum("y").alias("y")).collect()
    )
    h = np.array(sorted((r["raw"], r["n"], r["y"]) for r in found))
    model.knots, model.values = isotonic(h[:, 0], h[:, 1], h[:, 2])
    return model


def score(text: Column, model: Model) -> Column:
    """The calibrated score of a text column. The model is a few hundred KB, whatever the corpus."""

    @F.pandas_udf(T.DoubleType())
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(np.array([statistics(t) for t in texts]).reshape(-1, len(FEATURES))))

    return scored(text)


def classify(documents: DataFrame, labels: DataFrame, *, threshold: float = 0.3, **parameters) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every document."""
    model = fit(documents, labels, **parameters)
    return documents.select(
        "doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), score(F.col("text"), model).alias("score")
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(documents: DataFrame, labels: DataFrame, *, threshold: float = 0.3, **parameters) -> DataFrame:
    """The documents whose score reaches the threshold, with their own columns."""
    model = fit(documents, labels, **parameters)
    return documents.where(score(F.col("text"), model) >= threshold)
