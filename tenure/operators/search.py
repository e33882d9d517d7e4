"""Order statistics and quantiles of many weighted distributions at once, by ranges of values that are counted ever finer.

A *search* is one position in one distribution: the median of a draw's residuals, a trim's cut, the n-th smallest of a draw's
random keys. Each pass over the rows counts, for every search, the weight in BINS ranges between its bounds; the range that
holds the position becomes the next bounds. When FEW rows at most lie between the bounds they are looked at one by one, with
the nearest value on either side. A task gives out a row a search, whatever it reads, and the driver gets a row a
search and FEW values; values that many rows share count as one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS, FEW = 64, 64
#: Values (rows x searches) that a task looks at together.
CELLS = 1 << 19

#: Of a batch: values and weights, each rows x searches (or rows x 1); rows of weight 0 and infinite values take no part.
Look = Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]]


@dataclass
class Found:
    """What lies between the bounds of a search: values in order, their weights and the least weight of one of their rows; the
    weight before them; the nearest (value, weight) on either side, None where there is none."""

    values: np.ndarray
    weights: np.ndarray
    least: np.ndarray
    before: float
    left: tuple[float, float] | None
    right: tuple[float, float] | None
    wanted: float

    def _points(self) -> tuple[np.ndarray, np.ndarray]:
        """Cumulative weights and values between which quantiles are interpolated."""
        upto = self.before + np.cumsum(self.weights)
        at = np.stack([upto - self.weights + self.least / 2, upto - self.least / 2], axis=1).ravel()
        v = np.repeat(self.values, 2)
        if self.left:
            at, v = np.concatenate([[self.before - self.left[1] / 2], at]), np.concatenate([[self.left[0]], v])
        if self.right:
            at, v = np.concatenate([at, [upto[-1] + self.right[1] / 2]]), np.concatenate([v, [self.right[0]]])
        return at, v

    def quantile(self) -> float:
        """Interpolated between midpoints of the rows' weights; rows of one value are taken to have equal weights."""
        return float(np.interp(self.wanted, *self._points())) if len(self.values) else float("nan")

    def beside(self) -> tuple[float, float]:
        """The values between which the quantile lies; infinite where there is none."""
        if not len(self.values):
            return -np.inf, np.inf
        at, v = self._points()
        k = int(np.searchsorted(at, self.wanted))
        return float(v[k - 1]) if k else -np.inf, float(v[k]) if k < len(v) else np.inf

    def nth(self) -> float:
        """The least value up to which the wanted weight lies; minus infinity for none, infinity beyond all."""
        if self.wanted <= 0:
            return -np.inf
        upto = self.before + np.cumsum(self.weights)
        k = np.searchsorted(upto, self.wanted - 1e-9)
        return float(self.values[k]) if k < len(upto) else np.inf


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, len(b), max(1, rows)):
            yield b.slice(i, max(1, rows))


def _cells(look: Look, batch: pa.RecordBatch, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Values, NaN where a cell takes no part, and weights, rows x searches."""
    v, w = look(batch)
    if not (w > 0).all():
        v = np.where(w > 0, v, np.nan)
    return np.broadcast_to(v, (len(batch), n)), np.broadcast_to(w, (len(batch), n))


def _between(v: np.ndarray, w: np.ndarray, low: np.ndarray, high: np.ndarray, closed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(search, value, weight) of the cells between finite bounds: few, so only these are picked out."""
    row, search = np.nonzero((v >= low) & (v <= high))
    x = v[row, search]
    at = (x < high[search]) | closed[search]
    return search[at], x[at], w[row[at], search[at]]


def _per_search(rows: DataFrame, given: Callable, schema: str, n: int) -> DataFrame:
    """``given(parts)`` over slices of a task's batches."""
    return rows.mapInArrow(lambda batches: given(slices(batches, CELLS // n)), schema)


def _bounds(rows: DataFrame, look: Look, n: int) -> np.ndarray:
    """Least, largest, total weight and number of rows by search."""

    def given(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high, total, count = np.full(n, np.inf), np.full(n, -np.inf), np.zeros(n), np.zeros(n)
        for b in parts:
            v, w = _cells(look, b, n)
            some = np.isfinite(v)
            low = np.minimum(low, np.where(some, v, np.inf).min(axis=0, initial=np.inf))
            high = np.maximum(high, np.where(some, v, -np.inf).max(axis=0, initial=-np.inf))
            total += np.where(some, w, 0.0).sum(axis=0)
            count += some.sum(axis=0)
        yield pa.RecordBatch.from_pydict({"k": np.arange(n, dtype=np.int32), "low": low, "high": high, "w": total, "n": count})

    by = _per_search(rows, given, "k int, low double, high double, w double, n double", n).groupBy("k")
    out = np.tile(np.array([np.inf, -np.inf, 0.0, 0.0])[:, None], n)
    for r in by.agg(F.min("low"), F.max("high"), F.sum("w"), F.sum("n")).collect():
        out[:, r[0]] = r[1:]
    return out


def _counted(rows: DataFrame, look: Look, low: np.ndarray, high: np.ndarray, closed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges (BINS + 1), weights and numbers of rows (BINS) by search."""
    n = len(low)
    edges = low[:, None] + (high - low)[:, None] * (np.arange(BINS + 1) / BINS)
    edges[:, -1] = high

    def given(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, count = np.zeros(n * BINS), np.zeros(n * BINS)
        for b in parts:
            search, v, w = _between(*_cells(look, b, n), low, high, closed)
            width = (high - low)[search]
            k = np.clip(np.floor((v - low[search]) / np.where(width > 0, width, 1) * BINS).astype(np.int64), 0, BINS - 1)
            k -= (v < edges[search, k]) & (k > 0)  # the edges decide, not the division's rounding
            k += (v >= edges[search, k + 1]) & (k < BINS - 1)
            weight += np.bincount(search * BINS + k, w, n * BINS)
            count += np.bincount(search * BINS + k, minlength=n * BINS)
        both = np.concatenate([weight.reshape(n, BINS), count.reshape(n, BINS)], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int32)), *[pa.array(np.ascontiguousarray(c)) for c in both.T]], names=names)

    names = ["k", *[f"c{i}" for i in range(2 * BINS)]]
    parts = _per_search(rows, given, ", ".join([f"{c} {'int' if c == 'k' else 'double'}" for c in names]), n)
    out = np.zeros((n, 2 * BINS))
    for r in parts.groupBy("k").agg(*[F.sum(c) for c in names[1:]]).collect():
        out[r[0]] = r[1:]
    return edges, out[:, :BINS], out[:, BINS:]


def search(rows: DataFrame, look: Look, wanted: Callable[[np.ndarray], np.ndarray], n: int) -> list[Found]:
    """The ``n`` searches, at the cumulative weights that ``wanted`` makes of the total weights."""
    low, high, total, count = _bounds(rows, look, n)
    target, before, closed = np.asarray(wanted(total), dtype=float), np.zeros(n), np.ones(n, dtype=bool)
    low, high = np.where(count > 0, low, 0.0), np.where(count > 0, high, 0.0)
    while True:
        # closer bounds than these hold a few thousand different numbers at most, whatever the rows
        open_ = (count > FEW) & (high - low > 64 * BINS * np.spacing(np.maximum(np.abs(low), np.abs(high))))
        if not open_.any():
            break
        edges, weight, many = _counted(rows, look, low, np.where(open_, high, low), closed)
        upto = before[:, None] + np.cumsum(weight, axis=1)
        for s in np.flatnonzero(open_):
            some = np.flatnonzero(many[s])
            k = next((i for i in some if upto[s, i] >= target[s]), some[-1])
            before[s] = upto[s, k] - weight[s, k]
            low[s], high[s], closed[s], count[s] = edges[s, k], edges[s, k + 1], closed[s] and k == BINS - 1, many[s, k]
    return _listed(rows, look, low, high, closed, before, target)


def _listed(rows: DataFrame, look: Look, low: np.ndarray, high: np.ndarray, closed: np.ndarray, before: np.ndarray, target: np.ndarray) -> list[Found]:
    n = len(low)

    def given(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, float], list[float]] = {}
        left, right = np.full((n, 2), -np.inf), np.full((n, 2), np.inf)
        for b in parts:
            v, w = _cells(look, b, n)
            s, x, y = _between(v, w, low, high, closed)
            order = np.lexsort((x, s))
            s, x, y = s[order], x[order], y[order]
            first = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (x[1:] != x[:-1])])) if len(s) else order
            sums, least = (np.add.reduceat(y, first), np.minimum.reduceat(y, first)) if len(s) else (y, y)
            for key, total, lowest in zip(zip(s[first].tolist(), x[first].tolist(), strict=True), sums.tolist(), least.tolist(), strict=True):
                own = held.setdefault(key, [0.0, lowest])
                own[0], own[1] = own[0] + total, min(own[1], lowest)
            above = (v > high) | ((v == high) & ~closed)
            for side, sign, beyond in ((left, -1, v < low), (right, 1, above)):
                away = np.where(beyond, sign * v, np.inf)
                first, every = away.argmin(axis=0), np.arange(n)  # nearest first
                nearer = away[first, every] < sign * side[:, 0]
                side[nearer] = np.stack([v[first, every], w[first, every]], axis=1)[nearer]
        out = [(s, 0, x, w, least) for (s, x), (w, least) in held.items()]
        out += [(int(s), kind, *side[s], 0.0) for kind, side in ((-1, left), (1, right)) for s in np.flatnonzero(np.isfinite(side[:, 0]))]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["k", "side", "v", "w", "least"])

    types = [pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64()]
    parts = _per_search(rows, given, "k int, side int, v double, w double, least double", n)
    beside = parts.where("side <> 0").groupBy("k", "side").agg(F.min_by(F.struct("v", "w"), F.col("v") * F.col("side")).alias("x"))
    own = parts.where("side = 0").groupBy("k", "v").agg(F.sum("w").alias("w"), F.min("least").alias("least"))
    every = own.select("k", F.lit(0).alias("side"), "v", "w", "least").unionByName(beside.select("k", "side", "x.v", "x.w", F.lit(0.0).alias("least")))
    by: dict[int, list] = {}
    for r in every.collect():
        by.setdefault(r["k"], []).append(r)
    out = []
    for s in range(n):
        mine = by.get(s, [])
        values = sorted((r["v"], r["w"], r["least"]) for r in mine if r["side"] == 0)
        near = {r["side"]: (r["v"], r["w"]) for r in mine if r["side"]}
        v, w, least = np.array(values).T if values else np.zeros((3, 0))
        out.append(Found(v, w, least, float(before[s]), near.get(-1), near.get(1), float(target[s])))
    return out
