"""Contrasts after some financing labels are recoded, for any number of pairs: who is recoded is decided without a sort.

Recodings are drawn without replacement, at most one a pair: every end of a pair has a random key from a hash of the pair, the
end, the scenario and the draw (an exponential over the end's weight, or minus its effect where the worst are taken); a
pair stands for the least key of its ends. The n-th smallest key over all pairs is looked for near the one that the pairs' weights lead
to expect, for all scenarios and draws at once (the worst by ``search``). Any pass can then tell from a pair alone whether it is recoded.

The calendar doesn't change, so its Gram matrix is solved once; a last pass adds up what the new targets have in common with
it: two numbers a column, scenario and draw.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .estimation import inverse
from .passes import BLOCK, _seen, _sums, _unit, by_design, hashed, least_squares, residuals, rows_of, uniform
from .search import CELLS, search, slices
from .tables import written

#: Labels in the order in which ends are recoded.
CASH, FINANCED = 0, 1
#: Cells (pairs x draws) that are hashed at once, and cells (pairs x columns) of which a task looks at those near a limit together.
HASHED, SEEN = 1 << 14, 1 << 21
#: Keys near a limit that a task holds before it gives them out.
LISTED = 1 << 20
#: Levels of weights, so many to a factor of e.
LEVELS, FINE = 4096, 64
#: How far from the expected key a limit is looked for first, in roots of what is wanted.
REACH = 5


def design(pairs: DataFrame, area: str, cluster: str, pair: str, a: str, z: str, keep: list[str] | None = None, **parameters) -> DataFrame:
    """The pairs' rows without targets, with ``pair`` (a hash), ``fa``, ``fz``, residual growth ``r`` and ``keep``."""
    own = pairs.withColumns({"pair": F.xxhash64(pair), "fa": F.col(a).cast("int"), "fz": F.col(z).cast("int")})
    rows = rows_of(own, area, cluster, keep=["pair", "fa", "fz", *(keep or [])], **parameters)
    rows = rows.withColumn("x", F.filter("x", lambda e: ~e["k"].startswith("t:")))
    return written(residuals(rows, least_squares(rows, [])[1], "r"), "relabel")


def switch(a: np.ndarray, z: np.ndarray) -> np.ndarray:
    """1 from cash to financed, -1 from financed to cash, else 0."""
    return ((a == 0) & (z == 1)).astype(int) - ((a == 1) & (z == 0))


def ends(own: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Labels and effects (pairs x 2): by how much a recoding of that end alone lowers the contrast."""
    a, z, r = own["fa"], own["fz"], own["r"]
    before = switch(a, z)
    return np.stack([a, z], axis=1), np.stack([r * (before - switch(1 - a, z)), r * (before - switch(a, 1 - z))], axis=1)


class Recodings:
    """The recodings of all scenarios and draws, in columns scenario by scenario, and the limits of the keys found so far.

    The worst recodings are the same in every draw and have one column. Of the others few keys come near a limit, and a pair's
    weight tells from which hash on: a pass hashes each end for each draw, and looks only at the cells beyond that.
    """

    def __init__(self, scenarios: list[dict], draws: int, seed: int):
        self.scenarios, self.draws, self.seed = scenarios, draws, seed
        ends = np.cumsum([0, *[1 if s["mode"] == "adversarial" else draws for s in scenarios]]).tolist()
        self.at, self.width = [slice(*x) for x in zip(ends, ends[1:])], ends[-1]
        #: By label: the limit of the keys, and the mean and deviation of the pool's effects.
        self.limit: dict[int, np.ndarray] = {}
        self.pool: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self._free: dict[int, np.ndarray] = {}

    def by_draw(self, values: np.ndarray) -> np.ndarray:
        """Values of columns (along the first axis) as scenarios x draws."""
        return np.stack([np.broadcast_to(values[at], (self.draws, *values.shape[1:])) for at in self.at])

    def open_ends(self, own: dict[str, np.ndarray], label: int, i: int) -> np.ndarray:
        """Ends (pairs x 2) that scenario i may recode at this label, but for pairs that are recoded already."""
        pool = self.scenarios[i].get("pool")
        ok = np.stack([own["fa"], own["fz"]], axis=1) == label
        return ok & np.stack([own[f"{pool}_a"], own[f"{pool}_z"]], axis=1).astype(bool) if pool and label == CASH else ok

    def _tilt(self, label: int, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Where a scenario's weights are one, and how steep they are, by draw: an end weighs exp(steep x (signed effect - middle))."""
        s = self.scenarios[i]
        if s["mode"] != "tilted":
            return np.zeros(1), np.zeros(1)
        mean, spread = (x[self.at[i]] for x in self.pool[label])
        if label == CASH:  # nothing is recoded before: one pool for all draws
            mean, spread = mean[:1], spread[:1]
        return s.get("sign", 1.0) * mean, s.get("kappa", 1.0) / np.where(spread > 0, spread, 1)

    def _drawn(self, pairs: np.ndarray, signed: np.ndarray, label: int, end: int, i: int, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, column and key of the keys up to ``most`` (by column) of one end in a scenario that draws."""
        if not most.max() > 0:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
        middle, steep = self._tilt(label, i)
        beyond = [(signed - m) * k for m in (middle.min(), middle.max()) for k in (steep.min(), steep.max())]
        with np.errstate(over="ignore", invalid="ignore"):  # no hash below this comes near any column's limit; a little is left for rounding
            least = np.exp(-most.max() * np.exp(np.max(beyond, axis=0))) * (1 - 1e-12)
        least = np.maximum(np.nan_to_num(least) * 2.0**53 - 2, 0).astype(np.uint64)[:, None]
        numbers, step = np.arange(i * self.draws, (i + 1) * self.draws), max(1, HASHED // self.draws)
        cells, hashes = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.uint64)]
        for b in range(0, len(pairs), step):
            x = hashed(pairs[b : b + step], numbers, self.seed + 2 * label + end)
            some = np.flatnonzero(x >= least[b : b + step])
            cells.append(some + b * self.draws)
            hashes.append(x.ravel()[some])
        row, column = np.divmod(np.concatenate(cells), self.draws)
        key = -np.log(_unit(np.concatenate(hashes)))
        if self.scenarios[i]["mode"] == "tilted":
            k = column if len(middle) > 1 else 0
            key = key / np.exp(steep[k] * (signed[row] - middle[k]))
        keep = (key <= most[column]) & (key < np.inf)
        return row[keep], column[keep], key[keep]

    def _least(self, own: dict[str, np.ndarray], label: int, i: int, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row, column within the scenario, key and end of the pairs whose least key is up to ``most`` (by column)."""
        ok, signed = self.open_ends(own, label, i), self.scenarios[i].get("sign", 1.0) * ends(own)[1]
        found = []
        for end in (0, 1):
            some = np.flatnonzero(ok[:, end])
            if self.scenarios[i]["mode"] == "adversarial":
                key = -signed[some, end]
                row = np.flatnonzero(key <= most[0])
                column, key = np.zeros(len(row), dtype=np.int64), key[row]
            else:
                row, column, key = self._drawn(own["pair"][some], signed[some, end], label, end, i, most)
            found.append((some[row], column, key, np.full(len(row), end, dtype=np.int8)))
        if ok.all(axis=1).any():  # of a pair's two keys the less, the first of equal ones
            first, second = (row * len(most) + column for row, column, _, _ in found)
            key = np.full(len(ok) * len(most), np.inf)
            key[first] = found[0][2]
            before = key[second]
            less = found[1][2] < before
            key[second[less]] = np.nan
            found = [tuple(c[keep] for c in x) for x, keep in zip(found, (~np.isnan(key[first]), less), strict=True)]
        return tuple(np.concatenate(c) for c in zip(*found, strict=True))

    def _near(self, own: dict[str, np.ndarray], label: int, most: np.ndarray, i: int, gone: tuple[np.ndarray, np.ndarray] | None = None):
        """``_least`` without the pairs that are recoded already; ``gone`` are their rows and columns, where they are known."""
        row, column, key, end = self._least(own, label, i, most[self.at[i]])
        if label == FINANCED:
            if gone is None:
                both = np.flatnonzero(own["fa"] != own["fz"])  # others have no end of the other label
                at, columns, _, _ = self._least({c: v[both] for c, v in own.items()}, CASH, i, self.limit[CASH][self.at[i]])
                gone = both[at], columns
            width = self.at[i].stop - self.at[i].start
            taken = np.zeros(len(own["pair"]) * width, dtype=bool)
            taken[gone[0] * width + gone[1]] = True
            keep = ~taken[row * width + column]
            row, column, key, end = row[keep], column[keep], key[keep], end[keep]
        return row, column, key, end

    def recoded(self, own: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, column and new switch of the pairs that are recoded."""
        a, z = own["fa"], own["fz"]
        once, out = np.stack([switch(1 - a, z), switch(a, 1 - z)], axis=1), []
        own = {c: v for c, v in own.items() if isinstance(v, np.ndarray) and len(v) == len(a)}
        for i, at in enumerate(self.at):
            gone = None
            for label in (CASH, FINANCED):
                row, column, _, end = self._near(own, label, self.limit[label], i, gone)
                gone = row, column
                out.append((row, column + at.start, once[row, end]))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))

    def find(self, rows: DataFrame, label: int) -> None:
        """Set the pool's figures and the limit of one label, and the figures of the other label's pool that this takes ends from."""
        rows = rows.drop("x")
        if label == CASH:
            self._pools(rows)
        total, count, m, ss = self._free[label]
        m, ss = m / np.maximum(count, 1), ss / np.maximum(count, 1)
        self.pool[label] = m, np.sqrt(np.maximum(ss - m**2, 0))
        wanted = np.concatenate([np.full(at.stop - at.start, np.rint(s[{CASH: "h", FINANCED: "f"}[label]] * total[at.start])) for s, at in zip(self.scenarios, self.at, strict=True)])
        low, high, known = np.full(self.width, -np.inf), np.full(self.width, -np.inf), wanted <= 0
        worst = [i for i, s in enumerate(self.scenarios) if s["mode"] == "adversarial"]
        if worst:
            places = [self.at[i].start for i in worst]

            def look(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
                own, every = _plain(b), np.full(self.width, np.inf)
                out = np.full((len(b), len(worst)), np.inf)
                for k, i in enumerate(worst):
                    row, _, key, _ = self._near(own, label, every, i)
                    out[row, k] = key
                return out, np.ones((len(b), 1))

            low[places] = high[places] = [f.nth() for f in search(rows, look, lambda _: wanted[places], len(worst))]
            known[places] = True
        levels, reach = self._levels(rows, label), REACH
        while True:
            for i, level in levels.items():
                n = wanted[self.at[i]][0]
                if n > 0:
                    away = reach * (np.sqrt(n) + 1)
                    low[self.at[i]], high[self.at[i]] = _reached(level, n - away), _reached(level, n + away)
            limit, taken = self._limits(rows, label, np.where(known, -1, wanted), low, high)
            if not np.isnan(limit).any():
                break
            reach *= 4
        self.limit[label] = limit
        if label == CASH:
            self._free[FINANCED][1:] -= taken

    def _pools(self, rows: DataFrame) -> None:
        """By label and column, before anything is recoded: ends in all, those that can be recoded, and sums and squares of their effects."""
        many = len(self.scenarios)

        def given(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((2, 4, many))
            for b in batches:
                own = _plain(b)
                labels, effect = ends(own)
                for label in (CASH, FINANCED):
                    sums[label, 0] += (labels == label).sum()
                    for i in range(many):
                        e = effect[self.open_ends(own, label, i)]
                        sums[label, 1:, i] += len(e), e.sum(), e @ e
            yield pa.RecordBatch.from_pydict({"k": np.arange(sums.size, dtype=np.int32), "s": sums.ravel()})

        out = np.zeros(8 * many)
        for r in rows.mapInArrow(given, "k int, s double").groupBy("k").agg(F.sum("s")).collect():
            out[r[0]] = r[1]
        wide = np.repeat(out.reshape(2, 4, many), [at.stop - at.start for at in self.at], axis=2)
        self._free = {label: wide[label].copy() for label in (CASH, FINANCED)}

    def _levels(self, rows: DataFrame, label: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Of the scenarios that draw: how many pairs weigh about so much, in fine steps, and their mean weight.

        Pairs recoded before count by their chance of not being so. A scenario's draws are taken together: what this gives is only where to look.
        """
        drawing = [i for i, s in enumerate(self.scenarios) if s["mode"] != "adversarial"]

        def weights(own: dict[str, np.ndarray], effect: np.ndarray, label: int, i: int) -> np.ndarray:
            (middle, steep), sign = self._tilt(label, i), self.scenarios[i].get("sign", 1.0)
            return np.where(self.open_ends(own, label, i), np.exp(np.clip(steep.mean() * (sign * effect - middle.mean()), -300, 300)), 0.0).sum(axis=1)

        def given(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((2, len(drawing), LEVELS))
            for b in batches:
                own = _plain(b)
                effect = ends(own)[1]
                for k, i in enumerate(drawing):
                    w = weights(own, effect, label, i)
                    some = np.flatnonzero(w > 0)
                    left = np.ones(len(some))
                    if label == FINANCED:
                        before = np.maximum(self.limit[CASH][self.at[i]], 0).mean()
                        cash = weights(own, effect, CASH, i)[some]
                        left[cash > 0] = np.exp(-before * cash[cash > 0])
                    level = np.clip(np.log(w[some]) * FINE + LEVELS // 2, 0, LEVELS - 1).astype(np.int64)
                    sums[0, k] += np.bincount(level, left, LEVELS)
                    sums[1, k] += np.bincount(level, left * w[some], LEVELS)
            k, level = np.nonzero(sums[0])
            yield pa.RecordBatch.from_pydict({"k": k.astype(np.int32), "level": level.astype(np.int32), "n": sums[0, k, level], "w": sums[1, k, level]})

        parts = rows.mapInArrow(given, "k int, level int, n double, w double").groupBy("k", "level").agg(F.sum("n").alias("n"), F.sum("w").alias("w"))
        found: dict[int, list] = {i: [] for i in drawing}
        for r in parts.collect():  # scenarios x levels
            found[drawing[r["k"]]].append((r["n"], r["w"] / r["n"]))
        return {i: tuple(np.array(x).reshape(-1, 2).T) for i, x in found.items()}

    def _limits(self, rows: DataFrame, label: int, wanted: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The wanted keys by number, which should lie from ``low`` to ``high``, and NaN for those that don't; ``high`` where none is wanted.

        Keys below are counted, those between are listed, some LISTED of a task in one go, and put in order column by column: some times the root
        of what is wanted. With the limits of cash ends come number, sum and squares of the effects that the pairs up to the limit take from the
        other pool.
        """
        names = ["k", "n", "m", "e", "ee", "keys", "effects"]

        def given(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            below, held = np.zeros((4, self.width)), []

            def out(sums: np.ndarray, parts: list[tuple]) -> pa.RecordBatch:
                column, *rest = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else np.zeros((3, 0))
                order = np.argsort(column, kind="stable")
                cuts = 8 * np.searchsorted(column[order], np.arange(self.width + 1)).astype(np.int32)  # numbers have 8 bytes
                lists = [pa.Array.from_buffers(pa.binary(), self.width, [None, pa.py_buffer(cuts), pa.py_buffer(c[order])]) for c in rest]
                return pa.RecordBatch.from_arrays([pa.array(np.arange(self.width, dtype=np.int32)), *[pa.array(c) for c in sums], *lists], names=names)

            for b in slices(batches, SEEN // self.width):
                own = _plain(b)
                labels, effect = ends(own)
                for i, at in enumerate(self.at):
                    row, column, key, end = self._near(own, label, high, i)
                    column = column + at.start
                    e = np.where(labels[row, 1 - end] != label, effect[row, 1 - end], np.nan)
                    sure = key < low[column]
                    below[0] += np.bincount(column[sure], minlength=self.width)
                    some = np.flatnonzero(sure & ~np.isnan(e))
                    for x, v in zip(below[1:], (None, e[some], e[some] ** 2), strict=True):
                        x += np.bincount(column[some], v, self.width)
                    held.append((column[~sure], key[~sure], e[~sure]))
                if sum(len(h[0]) for h in held) > LISTED:
                    yield out(np.zeros((4, self.width)), held)
                    held = []
            yield out(below, held)

        def ordered(part: pa.Table) -> pa.Table:
            k = part["k"][0].as_py()
            below, *sums = (part[c].to_numpy().sum() for c in names[1:5])
            key, e = (np.concatenate([np.frombuffer(x.as_buffer()) for x in part[c]]) for c in names[5:])
            limit = high[k]
            if wanted[k] > 0:
                place = int(np.ceil(wanted[k] - below - 1e-9)) - 1
                limit = np.nan if place < 0 else np.partition(key, place)[place] if place < len(key) else np.inf if high[k] == np.inf else np.nan
            e = e[(key <= limit) & ~np.isnan(e)]
            taken = [float(x + y) for x, y in zip(sums, (len(e), e.sum(), e @ e), strict=True)]
            return pa.table({"k": pa.array([k], pa.int32()), "limit": [float(limit)], **{c: [x] for c, x in zip(names[2:5], taken, strict=True)}})

        limit, taken = np.where(wanted > 0, np.inf, high), np.zeros((3, self.width))
        schema = "k int, n double, m double, e double, ee double, keys binary, effects binary"
        found = rows.mapInArrow(given, schema).groupBy("k").applyInArrow(ordered, "k int, limit double, m double, e double, ee double")
        for r in found.collect():  # a row a column
            limit[r[0]], taken[:, r[0]] = r[1], r[2:]
        return limit, taken


def _reached(level: tuple[np.ndarray, np.ndarray], count: float) -> float:
    """The key up to which so many keys are expected, of pairs in numbers and weights."""
    n, weight = level
    if count <= 0 or count >= n.sum():
        return -np.inf if count <= 0 else np.inf
    low, high = -700.0, 700.0
    for _ in range(80):
        middle = (low + high) / 2
        few = n @ -np.expm1(-np.exp(middle) * weight) < count
        low, high = (middle, high) if few else (low, middle)
    return float(np.exp(high))


def _plain(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    return {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names if c != "x"}


def _moved(own: dict[str, np.ndarray], row: np.ndarray, column: np.ndarray, new: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``by_design`` of the pairs that switch to financing and of those that switch from it, after few cells were given new switches."""
    now, many = switch(own["fa"], own["fz"]), len(own["first"])
    place, y = own["design"][row] * width + column, own["y"][row]
    for sign in (1, -1):
        before = by_design(own, (now == sign).astype(float)[:, None])
        change = (new == sign).astype(float) - (now[row] == sign)
        some = np.flatnonzero(change)
        at, change = place[some], change[some]
        yield tuple(b + np.bincount(at, c, many * width).reshape(many, width) for b, c in zip(before, (change, change * y[some]), strict=True))


def refitted(rows: DataFrame, switches: Callable[[dict[str, np.ndarray]], np.ndarray | tuple], width: int, may: Column | None = None, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray]:
    """The contrast (half of cf less fc) by least squares for each column of new switches, and how many pairs have one.

    ``switches`` gives all of them (pairs x columns), which aren't counted, or row, column and new switch of those that are recoded, from slices of
    so many ``cells``. Pairs without ``may`` never switch."""
    fixed = {(r["i"], r["j"]): r["s"] for r in _sums(rows, lambda own: np.ones(len(own["w"])), 1, None).select("i", "j", F.col("s0").alias("s")).collect()}
    names = sorted({n for pair in fixed for n in pair} - {"y"})
    at = {n: k for k, n in enumerate(names)}
    gram, of_y = np.zeros((len(names), len(names))), np.zeros(len(names))
    for (i, j), s in fixed.items():
        if i == j == "y":
            continue
        if "y" in (i, j):
            of_y[at[i if j == "y" else j]] = s
        else:
            gram[at[i], at[j]] = gram[at[j], at[i]] = s
    blocks = -(-width // BLOCK)
    columns = [f"{side}{k}" for side in ("p", "m") for k in range(BLOCK)]

    def given(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, held = {"": 0, "+": 1, "y": 2}, np.zeros((3, 2, blocks * BLOCK))  # "" has the numbers of pairs, "+" of marked ones
        for b in slices(batches, cells // width):
            if not len(b):
                continue
            own = _seen(b)
            v = switches(own)
            if isinstance(v, tuple):
                held[1, 0, :width] += np.bincount(v[1], minlength=width)
                sides = _moved(own, *v, width)
            else:
                sides = (by_design(own, (v == sign).astype(float)) for sign in (1, -1))
            local = np.array([order.setdefault(n, len(order)) for n in own["names"]])
            held = np.concatenate([held, np.zeros((len(order) - len(held), *held.shape[1:]))])
            for side, (sums, outcome) in enumerate(sides):
                held[0, side, :width] += sums.sum(axis=0)
                held[2, side, :width] += outcome.sum(axis=0)
                for d, i in enumerate(own["first"]):
                    for e in range(own["offsets"][i], own["offsets"][i + 1]):
                        if (k := local[own["codes"][e]]) != 2:
                            held[k, side, :width] += own["v"][e] * sums[d]
        for k in range(blocks):
            part = held[:, :, k * BLOCK : (k + 1) * BLOCK].reshape(len(held), -1)
            arrays = [pa.array(list(order), pa.string()), pa.array(np.full(len(held), k, np.int32)), *[pa.array(np.ascontiguousarray(c)) for c in part.T]]
            yield pa.RecordBatch.from_arrays(arrays, names=["name", "block", *columns])

    schema = "name string, block int, " + ", ".join(f"{c} double" for c in columns)
    sums = (rows if may is None else rows.where(may)).mapInArrow(given, schema).groupBy("name", "block").agg(*[F.sum(c).alias(c) for c in columns])
    marked, n, shared, right = np.zeros((2, blocks * BLOCK)), np.zeros((2, blocks * BLOCK)), np.zeros((2, len(names), blocks * BLOCK)), np.zeros((2, blocks * BLOCK))
    for r in sums.collect():  # columns x scenarios and draws
        own, part = np.array(r[2:]).reshape(2, BLOCK), slice(r["block"] * BLOCK, (r["block"] + 1) * BLOCK)
        if r["name"] in at:
            shared[:, at[r["name"]], part] = own
        else:
            {"": n, "y": right, "+": marked}[r["name"]][:, part] = own
    inv = inverse(gram)
    solved = np.einsum("kl,slj->skj", inv, shared)
    left = np.einsum("skj,tkj->jst", shared, solved)
    m = np.stack([np.diag(n[:, j]) for j in range(width)]) - left[:width]
    b = (right - np.einsum("skj,k->sj", shared, inv @ of_y)).T[:width]
    beta = np.array([np.linalg.lstsq(x, y, rcond=None)[0] for x, y in zip(m, b, strict=True)])
    return 0.5 * (beta[:, 0] - beta[:, 1]), marked[0, :width].round().astype(int)


def relabelling(rows: DataFrame, scenarios: list[dict], *, draws: int, seed: int) -> DataFrame:
    """(scenario, draw, value, recoded): refits after shares of cash (``h``) and financed (``f``) ends are recoded.

    A scenario has a name, h, f, a mode (random, tilted, adversarial) and may have sign, kappa and ``pool``: then cash ends are
    recoded where the columns ``<pool>_a`` or ``<pool>_z`` say so, h still being a share of all. ``rows`` come from ``design``.
    """
    found = Recodings(scenarios, draws, seed)
    for label in (CASH, FINANCED):
        found.find(rows, label)
    values, counts = (found.by_draw(x) for x in refitted(rows, found.recoded, found.width, cells=SEEN))
    out = [(s["name"], d, float(values[i, d]), int(counts[i, d])) for i, s in enumerate(scenarios) for d in range(draws)]
    return rows.sparkSession.createDataFrame(out, "scenario string, draw int, value double, recoded int")


def hidden_labels(rows: DataFrame, cells: list[tuple[float, float]], *, draws: int, seed: int, screen: Column | None = None) -> DataFrame:
    """(q_fc, q_cf, draw, full, screened): refits after a share of each switching arm turns out financed at both ends, on all pairs and on
    those of the screen."""
    width = len(cells) * draws
    share = {-1: np.repeat([c[0] for c in cells], draws), 1: np.repeat([c[1] for c in cells], draws)}

    some = {arm: np.flatnonzero(np.rint(share[arm] * (1 << 52)) > 0) for arm in (-1, 1)}  # columns that recode the arm
    limit = {}
    for arm in (-1, 1):
        own = rows.where((F.col("fa") == int(arm == -1)) & (F.col("fz") == int(arm == 1))).select("pair")
        look = lambda b, arm=arm: (uniform(b.column(0).to_numpy(), some[arm], seed + arm), np.ones((len(b), 1)))
        wanted = lambda total, arm=arm: np.rint(share[arm][some[arm]] * total)
        limit[arm] = np.array([f.nth() for f in search(own, look, wanted, len(some[arm]))]) if len(some[arm]) else np.zeros(0)

    def switches(own: dict[str, np.ndarray]) -> np.ndarray:
        now = switch(own["fa"], own["fz"])
        new = np.repeat(now.astype(np.int8)[:, None], width, axis=1)
        for arm in (-1, 1):
            at = np.flatnonzero(now == arm)
            new[np.ix_(at, some[arm])] = np.where(uniform(own["pair"][at], some[arm], seed + arm) <= limit[arm], 0, arm)
        return new

    switching = F.col("fa") != F.col("fz")
    full = refitted(rows, switches, width, switching)[0]
    part = refitted(rows if screen is None else rows.where(screen), switches, width, switching)[0]
    out = [(*map(float, cells[k // draws]), k % draws, float(full[k]), float(part[k])) for k in range(width)]
    return rows.sparkSession.createDataFrame(out, "q_fc double, q_cf double, draw int, full double, screened double")
