"""Robust estimators and bootstrap draws by passes over the pairs, for samples of any size.

The pairs are written down once as sparse rows of the design. A pass weighs each row in its task, by the residuals from
the last coefficients or by the draws' cluster weights, and adds up the products of its entries there; what is shuffled
and collected is columns x columns (a draw), whatever the number of pairs. Cluster weights are Poisson counts from a hash
of the seed, the draw and the cluster: every task, screen and estimator sees the same draws, and none are sent.

Quantiles are searched by counts, see ``search``. Estimators that reweigh by their own residuals do so for all draws at
once: a pass takes every unsettled draw's coefficients and gives its sums, and draws that rest leave.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .estimation import Fit, _products, contrast_entries, inverse, solve, solved
from .resampling import HUBER, TRIMS, half
from .search import Found, search, slices
from .tables import written

#: Draws whose sums stand in one row.
BLOCK = 32
#: Sums that a task holds before it gives them out.
HELD = 4_000_000
#: Rows that are worth a task, as each is weighed for every draw; fewer are dealt over all cores.
MANY = 50_000
#: Products (rows x pairs of entries x draws) that a task forms at once.
CELLS = 4_000_000


def rows_of(pairs: DataFrame, area: str, cluster: str, *, keep: list[str] | None = None, weight: Column | None = None, **design) -> DataFrame:
    """The pairs as sparse rows: ``x`` (entries), ``c`` (hash of the cluster), ``w``, ``g`` (annual growth) and ``keep``.

    Rows of one design lie beside each other in a file, as passes add them up first.
    """
    years = F.datediff("date_z", "date_a") / 365.25
    w = F.lit(1.0) if weight is None else weight.cast("double")
    entries = contrast_entries(area, **design).alias("x")
    own = pairs.select(entries, F.xxhash64(cluster).alias("c"), w.alias("w"), (F.col("y") / years).alias("g"), *(keep or []))
    rows = written(own, "pairs")
    return dealt(rows, -(-rows.count() // MANY))


def dealt(rows: DataFrame, least: int = 1) -> DataFrame:
    """The rows by ranges of designs, a range a core and ``least`` at least, written down; the rows of one design may be many, so their clusters
    are dealt too."""
    design = F.xxhash64(F.filter("x", lambda e: e["k"] != "y").cast("string"))
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, least)
    return written(rows.repartitionByRange(tasks, design, "c").sortWithinPartitions(design), "design")


#: Coefficients by column: a number, or one a draw.
Coefficients = dict[str, float] | dict[str, np.ndarray]


def _designs(own: dict[str, np.ndarray], mask: str | None) -> dict[str, np.ndarray]:
    """Of a batch: the outcome ``y`` of each row, which ``design`` (its other entries, and the mask) it has, and each design's ``first`` row."""
    n, offsets = len(own["offsets"]) - 1, own["offsets"]
    row = np.repeat(np.arange(n), np.diff(offsets))
    outcome = np.array([name == "y" for name in own["names"]], dtype=bool)[own["codes"]]
    y = np.bincount(row[outcome], own["v"][outcome], n)
    place = np.arange(len(row)) - offsets[:-1][row]
    width = int(place.max(initial=0)) + 1
    key = np.full((n, 2 * width + 1), -1, dtype=np.int64)
    key[row, place] = np.where(outcome, -1, own["codes"])
    key[row, width + place] = np.where(outcome, 0.0, own["v"] + 0.0).view(np.int64)
    key[:, -1] = own[mask] if mask else 0
    _, first, design = np.unique(key.view(np.dtype((np.void, key.itemsize * key.shape[1]))).ravel(), return_index=True, return_inverse=True)
    return {"y": y, "design": design, "first": first}


def _seen(batch: pa.RecordBatch, coefficients: Coefficients | None = None, mask: str | None = None) -> dict[str, np.ndarray]:
    """A batch's ``c``, ``w``, ``g``, its entries (``names``, ``codes``, ``v``, ``offsets``), its designs and, with coefficients, residuals
    ``e``: a number a row, or rows x draws. A column that a fit hasn't got counts as nothing."""
    x = batch.column(batch.schema.names.index("x"))
    own = {c: batch.column(batch.schema.names.index(c)).to_numpy(zero_copy_only=False) for c in batch.schema.names if c != "x"}
    offsets = x.offsets.to_numpy()
    entries = x.values.slice(offsets[0], offsets[-1] - offsets[0])
    spelt = entries.field(0).dictionary_encode()
    own |= {"names": spelt.dictionary.to_pylist(), "codes": spelt.indices.to_numpy(), "v": entries.field(1).to_numpy(zero_copy_only=False), "offsets": offsets - offsets[0]}
    own |= _designs(own, mask)
    if coefficients is not None:
        fitted = _fitted(own, coefficients)
        own["e"] = own["y"] - fitted[own["design"]] if fitted.ndim == 1 else own["y"][:, None] - fitted[own["design"]]
    return own


def _fitted(own: dict[str, np.ndarray], coefficients: Coefficients) -> np.ndarray:
    """What the coefficients make of each design: a number, or one a draw."""
    width = next((np.shape(b) for b in coefficients.values()), ())
    by = np.array([np.zeros(width) if n == "y" else coefficients.get(n, np.zeros(width)) for n in own["names"]]).reshape(len(own["names"]), *width)
    fitted = np.zeros((len(own["first"]), *width))
    for d, i in enumerate(own["first"]):
        at = slice(own["offsets"][i], own["offsets"][i + 1])
        fitted[d] = own["v"][at] @ by[own["codes"][at]]
    return fitted


def by_design(own: dict[str, np.ndarray], weights: np.ndarray, outcome: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sums (designs x columns) of the weights and of the weighted outcome, or of what stands for it."""
    many, n = len(own["first"]), len(weights)
    if many <= 16:
        one = np.zeros((many, n))
        one[own["design"], np.arange(n)] = 1
        return one @ weights, one * own["y"] @ weights if outcome is None else one @ outcome.reshape(n, -1)
    by = np.argsort(own["design"], kind="stable")
    starts = np.flatnonzero(np.diff(own["design"][by], prepend=-1))
    outcome = weights * own["y"][:, None] if outcome is None else outcome.reshape(n, -1)
    return np.add.reduceat(weights[by], starts, axis=0), np.add.reduceat(outcome[by], starts, axis=0)


def _sums(
    rows: DataFrame, weigh: Callable[[dict[str, np.ndarray]], np.ndarray], width: int, coefficients: Coefficients | None, mask: str | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """(i, j, block, s0..): sums of the products of entries by the weights (rows x ``width``) that ``weigh`` gives.

    ``weigh`` sees a batch's ``c``, ``w``, ``g`` and ``keep`` and, with coefficients, the residuals ``e``. It may give two arrays: weights, and
    what stands for the weighted outcome. The outcome's square isn't summed. With ``mask``, a column of small whole numbers, sums are apart by its values, in a column
    ``mask``. Weights are added up by design first, so products are formed once a design; rows in the order of their designs make few.
    """
    columns = [f"s{k}" for k in range(min(BLOCK, width))]
    blocks = -(-width // BLOCK)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, at, held = {"y": 0}, {}, np.zeros((0, blocks * len(columns)))

        def given() -> Iterator[pa.RecordBatch]:
            spelt = list(names)
            pairs = [sorted((spelt[k >> 24 & 0xFFFFFF], spelt[k & 0xFFFFFF])) for k in at]
            masks = pa.array([k >> 48 for k in at], pa.int32())
            for b in range(blocks):
                own = held[: len(at), b * len(columns) : (b + 1) * len(columns)]
                arrays = [pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.string()), pa.array(np.full(len(at), b, np.int32)), masks]
                yield pa.RecordBatch.from_arrays([*arrays, *[pa.array(np.ascontiguousarray(c)) for c in own.T]], names=["i", "j", "block", "mask", *columns])

        for batch in slices(batches, CELLS // (16 * width)):
            if not len(batch):
                continue
            own = _seen(batch, coefficients, mask)
            weights = weigh(own)
            weights, outcome = weights if isinstance(weights, tuple) else (weights, None)
            weights = weights.reshape(len(batch), -1)
            sums = np.concatenate(by_design(own, weights, outcome))
            # a design's entries without the outcome, then what they share with it
            first, many = own["first"], len(own["first"])
            lengths = np.diff(own["offsets"])[first]
            place = np.repeat(own["offsets"][first] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
            code = np.array([names.setdefault(n, len(names)) for n in own["names"]])[own["codes"][place]]
            plain = code > 0
            design, code, v = np.repeat(np.arange(many), lengths)[plain], code[plain], own["v"][place][plain]
            offsets = np.concatenate([[0], np.cumsum(np.bincount(design, minlength=many))])
            row, key, product = _products(offsets, code, v)
            row, key, product = np.concatenate([row, design + many]), np.concatenate([key, code.astype(np.int64)]), np.concatenate([product, v])
            if mask:
                key |= own[mask].astype(np.int64)[first[row % many]] << 48
            order = np.argsort(key, kind="stable")
            found, begin = np.unique(key[order], return_index=True)
            places = [at.setdefault(k, len(at)) for k in found.tolist()]
            if len(at) > len(held):
                held = np.concatenate([held, np.zeros((max(len(at) - len(held), len(held), 64), held.shape[1]))])
            held[places, :width] += np.add.reduceat(sums[row[order]] * product[order][:, None], begin, axis=0)
            if held.size > HELD:
                yield from given()
                at, held = {}, np.zeros((0, held.shape[1]))
        if at:
            yield from given()

    schema = "i string, j string, block int, mask int, " + ", ".join(f"{c} double" for c in columns)
    parts = rows.select("x", "c", "w", "g", *keep, *([mask] if mask else [])).mapInArrow(added, schema)
    return parts.groupBy("i", "j", "block", *(["mask"] if mask else [])).agg(*[F.sum(c).alias(c) for c in columns])


def _one(rows: DataFrame, targets: list[str], weigh, coefficients: dict[str, float] | None = None) -> tuple[Fit, dict[str, float]]:
    """The fit by one pass, and all coefficients by name."""
    fit = solve(_sums(rows, weigh, 1, coefficients).select("i", "j", F.col("s0").alias("s")), targets)
    return fit, _named(fit, targets)


def least_squares(rows: DataFrame, targets: list[str]) -> tuple[Fit, dict[str, float]]:
    return _one(rows, targets, lambda own: own["w"])


def residuals(rows: DataFrame, coefficients: dict[str, float], name: str = "e") -> DataFrame:
    """The rows with what the coefficients leave of the outcome."""
    schema = f"{', '.join(f'{c} {t}' for c, t in rows.dtypes)}, {name} double"

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(b.schema.names.index("x"))
            spelt = x.flatten().field(0).dictionary_encode()
            add = np.array([1.0 if n == "y" else -coefficients[n] for n in spelt.dictionary.to_pylist()])
            row = np.repeat(np.arange(len(b)), np.diff(x.offsets.to_numpy()))
            e = np.bincount(row, x.flatten().field(1).to_numpy(zero_copy_only=False) * add[spelt.indices.to_numpy()], len(b)) if len(b) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(e)], names=[*b.schema.names, name])

    return rows.mapInArrow(left, schema)


def quantiles(rows: DataFrame, value: str, weight: str, shares: list[float]) -> list[float]:
    """Quantiles of the midpoint-weighted distribution, by interpolation, without ordering all values; see ``search``."""
    columns = rows.select(F.col(value).cast("double").alias("v"), F.col(weight).cast("double").alias("w")).where("v is not null and w > 0")
    n = len(shares)
    look = lambda b: (np.tile(b.column(0).to_numpy()[:, None], (1, n)), np.tile(b.column(1).to_numpy()[:, None], (1, n)))
    return [f.quantile() for f in search(columns, look, lambda total: np.array(shares) * total, n)]


def quantile(rows: DataFrame, value: str, weight: str, share: float) -> float:
    return quantiles(rows, value, weight, [share])[0]


def mad_scale(rows: DataFrame, value: str, weight: str = "w") -> float:
    middle = quantile(rows, value, weight, 0.5)
    return quantile(rows.withColumn("__far", F.abs(F.col(value) - middle)), "__far", weight, 0.5) / 0.6745


#: Outcomes of one design that stand in one row of a table of runs.
RUN = 256


def runs_of(rows: DataFrame, names: list[str]) -> DataFrame:
    """The rows as runs of one design: ``k`` (codes of its columns among ``names``), ``v`` and the arrays ``y`` and ``w``, RUN rows at most.

    What a fit that reweighs reads in every pass: numbers without names, a design once.
    """
    at = {n: i for i, n in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            own = _seen(b)
            order = np.argsort(own["design"], kind="stable")
            design = own["design"][order]
            new = np.flatnonzero(np.diff(design, prepend=-1))
            place = np.arange(len(design)) - np.repeat(new, np.diff(np.append(new, len(design))))
            starts = np.flatnonzero(place % RUN == 0)
            first = own["first"][design[starts]]
            lengths = np.diff(own["offsets"])[first]
            entry = np.repeat(own["offsets"][first] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
            code = np.array([at.get(n, -1) for n in own["names"]])[own["codes"][entry]]
            plain = code >= 0
            ends = np.append(0, np.cumsum(np.bincount(np.repeat(np.arange(len(first)), lengths)[plain], minlength=len(first)))).astype(np.int32)
            many = np.append(starts, len(design)).astype(np.int32)
            lists = [(ends, code[plain].astype(np.int32)), (ends, own["v"][entry][plain]), (many, own["y"][order]), (many, own["w"][order])]
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(o, pa.array(x)) for o, x in lists], names=["k", "v", "y", "w"])

    return written(rows.select("x", "c", "w", "g").mapInArrow(run, "k array<int>, v array<double>, y array<double>, w array<double>"), "runs")


def _left(batch: pa.RecordBatch, b: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """(offsets, values) of the columns of a batch of runs, and what the coefficients leave of each outcome."""
    lists = [(c.offsets.to_numpy() - c.offsets[0].as_py(), c.flatten().to_numpy(zero_copy_only=False)) for c in batch.columns]
    (entry, k), (_, v), (many, y), _ = lists
    fitted = np.bincount(np.repeat(np.arange(len(batch)), np.diff(entry)), v * b[k], len(batch))
    return lists, y - np.repeat(fitted, np.diff(many))


def _reweighed(runs: DataFrame, names: list[str], b: np.ndarray, limit: float) -> DataFrame:
    """(i, j, s): sums of products weighed down by the residuals, without the outcome's square."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(names)  # the outcome's code
        keys, sums = np.zeros(0, dtype=np.int64), np.zeros(0)
        for batch in batches:
            if not len(batch):
                continue
            ((entry, k), (_, v), (many, y), (_, w)), e = _left(batch, b)
            down = w * np.minimum(1.0, limit / np.maximum(np.abs(e), 1e-12))
            weight, outcome = np.add.reduceat(down, many[:-1]), np.add.reduceat(down * y, many[:-1])
            row, key, product = _products(entry, k, v)
            own = np.repeat(np.arange(len(batch)), np.diff(entry))
            keys, at = np.unique(np.concatenate([keys, key, k.astype(np.int64) << 24 | n]), return_inverse=True)
            sums = np.bincount(at, np.concatenate([sums, product * weight[row], v * outcome[own]]), len(keys))
        spelt = [*names, "y"]
        pairs = [sorted((spelt[x >> 24], spelt[x & 0xFFFFFF])) for x in keys.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.string()), pa.array(sums)], names=["i", "j", "s"])

    return runs.mapInArrow(added, "i string, j string, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))


def _named(fit: Fit, targets: list[str]) -> dict[str, float]:
    nuisance = fit.of_y - fit.of_targets @ fit.beta
    return dict(zip(fit.nuisance, nuisance.tolist(), strict=True)) | {f"t:{n}": float(b) for n, b in zip(targets, fit.beta, strict=True)}


def huber(
    rows: DataFrame, targets: list[str], *, tolerance: float = 1e-7, most: int = 1000, start: tuple[Fit, dict[str, float]] | None = None
) -> tuple[np.ndarray, dict[str, float], float]:
    """Huber's estimator: a pass a reweighting; the scale is set from least squares (``start``, if known) and once more from the result.

    Coefficients of the targets, all coefficients, and the scale of the last weights. Passes read ``runs_of`` the rows, and a scale's
    searches the residuals as written down.
    """
    fit, named = start or least_squares(rows, targets)
    names = sorted(named)
    runs = runs_of(rows, names)
    for _ in range(2):
        b = np.array([named[n] for n in names])

        def left(batches: Iterator[pa.RecordBatch], b: np.ndarray = b) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if len(batch):
                    lists, e = _left(batch, b)
                    yield pa.RecordBatch.from_arrays([pa.array(e), pa.array(lists[3][1])], names=["e", "w"])

        scale, beta = mad_scale(written(runs.mapInArrow(left, "e double, w double"), "residuals"), "e"), None
        for _ in range(most):
            fit = solve(_reweighed(runs, names, np.array([named[n] for n in names]), HUBER * scale), targets)
            named = _named(fit, targets)
            if beta is not None and np.abs(fit.beta - beta).max() < tolerance:
                break
            beta = fit.beta
        else:
            raise RuntimeError("Huber's reweighting did not settle")
        beta = fit.beta
    return beta, named, scale


def fit_all(rows: DataFrame, robust: np.ndarray | None = None) -> dict[str, float]:
    """Least squares, Huber (``robust``, if known) and both trims of the contrast."""
    targets = ["cf", "fc"]
    start = least_squares(rows, targets)
    out = {"ols": half(start[0].beta), "huber": half(huber(rows, targets, start=start)[0] if robust is None else robust)}
    cuts = quantiles(rows, "g", "w", [s / 100 for pair in TRIMS.values() for s in pair])
    for k, name in enumerate(TRIMS):
        out[name] = half(least_squares(rows.where(F.col("g").between(cuts[2 * k], cuts[2 * k + 1])), targets)[0].beta)
    return out


def hashed(keys: np.ndarray, draws: np.ndarray, seed: int) -> np.ndarray:
    """Hashes (keys x draws) of 53 bits."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.int64).view(np.uint64)[:, None] ^ ((draws.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x ^= x >> np.uint64(shift)
            x *= np.uint64(factor)
        x ^= x >> np.uint64(31)
        x >>= np.uint64(11)
        return x


def _unit(x: np.ndarray) -> np.ndarray:
    return x.astype(np.float64) / float(1 << 53) + 2.0**-54


def uniform(keys: np.ndarray, draws: np.ndarray, seed: int) -> np.ndarray:
    """Numbers (keys x draws) above 0 and up to 1 from hashes of 64 bits."""
    return _unit(hashed(keys, draws, seed))


#: Upper ends of the uniform numbers that give 0, 1, .. in the Poisson distribution with mean one; the count of each 2048th of them, and
#: where an end lies within.
POISSON = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 18)]))
COUNT = np.searchsorted(POISSON, np.arange(2048) / 2048, side="right").astype(np.float64)
BETWEEN = np.searchsorted(POISSON, (np.arange(2048) + 1) / 2048, side="right") != COUNT


def poisson(cluster: np.ndarray, draws: np.ndarray, seed: int) -> np.ndarray:
    """Counts (clusters x draws) of the Poisson distribution with mean one."""
    x = hashed(cluster, draws, seed)
    part = (x >> np.uint64(42)).view(np.int64)
    out = COUNT[part]
    unsure = np.nonzero(BETWEEN[part])
    out[unsure] = np.searchsorted(POISSON, _unit(x[unsure]), side="right")
    return out


def _systems(part: pd.DataFrame, width: int) -> Iterator[tuple[int, list[str], np.ndarray]]:
    """(draw, names, Gram matrix) of the draws of one block of sums."""
    names = sorted({*part["i"], *part["j"]})
    at = {n: k for k, n in enumerate(names)}
    i, j = part["i"].map(at).to_numpy(), part["j"].map(at).to_numpy()
    for k in range(min(BLOCK, width)):
        draw = int(part["block"].iloc[0]) * BLOCK + k
        if draw < width:
            full = np.zeros((len(names), len(names)))
            full[i, j] = full[j, i] = part[f"s{k}"].to_numpy()
            yield draw, names, full


def bootstrap(rows: DataFrame, contrasts: dict[str, tuple[str, str]], *, draws: int = 999, seed: int = 20260909) -> DataFrame:
    """(draw, estimator, value): least squares on common cluster draws, half the difference of each pair of targets.

    A pass over the rows serves all draws; the systems of BLOCK draws are solved in one task.
    """
    return _contrasts(_sums(rows, drawn(np.arange(draws), seed), draws, None), ["block"], contrasts, draws)


#: Clusters whose multinomial counts a task holds for all draws.
CLUSTERS = 16_384


def multinomial(rows: DataFrame, cluster: str, contrasts: dict[str, tuple[str, str]], *, draws: int = 999, seed: int = 20260909) -> DataFrame:
    """``bootstrap`` on multinomial counts of the clusters, which add up to the number of clusters in each draw, for any number of pairs.

    Up to CLUSTERS clusters the counts are NumPy's sequence of the seed over the clusters in order, as a publication takes them. More
    are dealt to blocks by a hash: a draw's total is split over the blocks, and a block's share over its clusters by a sequence of its own,
    which is the same distribution. ``rows`` have the column ``cluster``; a task makes the counts of a block as it meets its rows.
    """
    keys = rows.select(F.col(cluster).alias("__k")).distinct()
    total = keys.count()
    many = max(1, -(-total * 5 // (CLUSTERS * 4))) if total > CLUSTERS else 1
    keys = keys.withColumn("block_", F.pmod(F.xxhash64("__k"), F.lit(many)).cast("int"))
    codes = written(keys.withColumn("code_", F.row_number().over(Window.partitionBy("block_").orderBy("__k")) - 1), "clusters")  # a block is small
    sizes = np.zeros(many, dtype=np.int64)
    for r in codes.groupBy("block_").count().collect():
        sizes[r[0]] = r[1]
    share = np.random.default_rng([seed, 0]).multinomial(total, sizes / max(total, 1), size=draws) if many > 1 else np.full((draws, 1), total)
    dealt = rows.join(codes, F.col(cluster).eqNullSafe(F.col("__k"))).drop("__k")
    cores = rows.sparkSession.sparkContext.defaultParallelism
    design = F.xxhash64(F.filter("x", lambda e: e["k"] != "y").cast("string"))
    dealt = dealt.repartitionByRange(max(cores, many), "block_", "code_") if many > 1 else dealt.repartitionByRange(cores, design)
    dealt = written(dealt.sortWithinPartitions("block_", design), "dealt")
    made: dict[int, np.ndarray] = {}

    def counts(block: int) -> np.ndarray:
        if block not in made:
            made.clear()
            rng, n = np.random.default_rng(seed if many == 1 else [seed, block + 1]), sizes[block]
            chances = np.repeat(1 / n, n)
            made[block] = np.array([rng.multinomial(s, chances).astype(np.uint16) for s in share[:, block]]).T.copy()
        return made[block]

    def weigh(own: dict[str, np.ndarray]) -> np.ndarray:
        out = np.zeros((len(own["w"]), draws))
        for block in np.unique(own["block_"]):
            at = np.flatnonzero(own["block_"] == block)
            out[at] = counts(int(block))[own["code_"][at]] * own["w"][at][:, None]
        return out

    return _contrasts(_sums(dealt, weigh, draws, None, keep=("block_", "code_")), ["block"], contrasts, draws)


def _contrasts(sums: DataFrame, keys: list[str], contrasts: dict[str, tuple[str, str]], draws: int) -> DataFrame:
    """The systems of each group of sums solved; ``screen``, where it is a key, names the estimators."""
    targets = list(dict.fromkeys(t for pair in contrasts.values() for t in pair))

    def fitted(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for draw, names, full in _systems(part, draws):
            beta = dict(zip(targets, solved(names, full, targets).beta, strict=True))
            out += [(draw, part["screen"].iloc[0] if "screen" in keys else name, 0.5 * (beta[a] - beta[b])) for name, (a, b) in contrasts.items()]
        return pd.DataFrame(out, columns=["draw", "estimator", "value"])

    return sums.groupBy(*keys).applyInPandas(fitted, "draw int, estimator string, value double")


def drawn(draws: np.ndarray, seed: int) -> Callable[[dict[str, np.ndarray]], np.ndarray]:
    """Weights (rows x draws) of a batch: the cluster's count in each draw times the row's own."""
    return lambda own: poisson(own["c"], draws, seed) * own["w"][:, None]


def fits(
    rows: DataFrame, targets: list[str], weigh, width: int, coefficients: Coefficients | None = None, *, plus: DataFrame | None = None
) -> dict[str, np.ndarray]:
    """Coefficients by column, one a draw, of ``width`` weighted fits from one pass; systems are solved in tasks.

    ``plus`` are the sums of further rows, as ``_sums`` gives them.
    """

    def fitted(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for draw, names, full in _systems(part, width):
            fit = solved(names, full, targets)
            values = [*(fit.of_y - fit.of_targets @ fit.beta), *fit.beta]
            out.append((draw, [*fit.nuisance, *[f"t:{t}" for t in targets]], list(map(float, values))))
        return pd.DataFrame(out, columns=["draw", "names", "b"])

    sums = _sums(rows, weigh, width, coefficients)
    if plus is not None:
        sums = sums.unionByName(plus).groupBy("i", "j", "block").agg(*[F.sum(c).alias(c) for c in sums.columns[3:]])
    out: dict[str, np.ndarray] = {}
    for r in sums.groupBy("block").applyInPandas(fitted, "draw int, names array<string>, b array<double>").collect():  # draws x columns
        for name, b in zip(r["names"], r["b"], strict=True):
            out.setdefault(name, np.zeros(width))[r["draw"]] = b
    return out


#: What lies beyond the spread of a draw's rank, in standard errors, as quantiles are looked for; all rows in the end.
REACH = (5, 20, np.inf)
#: By how much of itself the range of the draws' fitted values is made wider, as Huber's estimator moves on.
WIDER = 0.5
#: Newton's steps in which a draw has to rest; what doesn't is reweighed.
STEPS = 12


def _totals(rows: DataFrame, draws: np.ndarray, seed: int, marks: list[Column]) -> np.ndarray:
    """Weights (marks x draws) of the rows that have each mark, added up by cluster before they are drawn."""
    by = rows.groupBy("c").agg(*[F.sum(F.when(m, F.col("w")).otherwise(0.0)).alias(f"m{k}") for k, m in enumerate(marks)])
    many = len(marks)

    def given(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((many, len(draws)))
        for b in slices(batches, CELLS // (8 * len(draws))):
            sums += np.stack([c.to_numpy() for c in b.columns[1:]]) @ poisson(b.column(0).to_numpy(), draws, seed)
        yield pa.RecordBatch.from_pydict({"k": np.arange(sums.size, dtype=np.int32), "s": sums.ravel()})

    out = np.zeros(many * len(draws))
    for r in by.mapInArrow(given, "k int, s double").groupBy("k").agg(F.sum("s")).collect():
        out[r[0]] = r[1]
    return out.reshape(many, len(draws))


def _spread(rows: DataFrame) -> float:
    """The standard error of a draw's total, of the total: what ranks move by."""
    by = rows.groupBy("c").agg(F.sum("w").alias("w")).agg(F.sum(F.col("w") * F.col("w")), F.sum("w")).first()
    return float(np.sqrt(by[0]) / by[1]) if by[1] else np.inf


def draw_quantile(
    rows: DataFrame, value: Callable[[pa.RecordBatch], np.ndarray], low: Column, high: Column, share: float, draws: np.ndarray, seed: int, spread: float
) -> np.ndarray:
    """A quantile of each draw's values, which lie between ``low`` and ``high`` of a row in every draw.

    Rows that lie on one side of all draws' quantiles only count by their clusters' weights; the others, a small share where rows are
    many, are looked at for each draw. What is found is held against the bounds that were taken; if it lies beyond, they are set wider.
    """
    middle = (low + high) / 2
    rows = rows.where(F.abs(middle) < float("inf"))

    def look(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        c, w = (batch.column(batch.schema.names.index(n)).to_numpy() for n in "cw")
        return value(batch), poisson(c, draws, seed) * w[:, None]

    for reach in REACH:
        apart = float(reach * spread * np.sqrt(share * (1 - share)))
        near = rows.agg(F.percentile_approx(middle, [max(share - apart, 0.0), min(share + apart, 1.0)], 10_000), F.avg((high - low) / 2)).first()
        if near[0] is None:
            return np.full(len(draws), np.nan)
        below = near[0][0] - near[1] if share > apart else -np.inf
        above = near[0][1] + near[1] if share + apart < 1 else np.inf
        total, before = _totals(rows, draws, seed, [F.lit(True), high < float(below)])
        few = dealt(rows.where((high >= float(below)) & (low <= float(above))))
        found = search(few, look, lambda _, total=total, before=before: share * total - before, len(draws))
        sides = np.array([f.beside() for f in found])
        if (sides[:, 0] >= below).all() and (sides[:, 1] <= above).all():
            break
    return np.array([f.quantile() for f in found])


def _ranged(rows: DataFrame, coefficients: dict[str, np.ndarray], wider: float = 0.0) -> DataFrame:
    """The rows with ``lo`` and ``hi``, the least and the largest residual in any draw; the range is made wider by a share of itself."""

    def given(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                own = _seen(b)
                fitted = _fitted(own, coefficients)
                low, high = fitted.min(axis=1), fitted.max(axis=1)
                more = wider * (high - low) + 1e-9  # more than rounding
                ends = (own["y"] - (high + more)[own["design"]], own["y"] - (low - more)[own["design"]])
                yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(e) for e in ends]], names=[*b.schema.names, "lo", "hi"])

    rows = rows.select("x", "c", "w", "g")
    return written(rows.mapInArrow(given, f"{', '.join(f'{c} {t}' for c, t in rows.dtypes)}, lo double, hi double"), "ranged")


def _scales(rows: DataFrame, named: dict[str, np.ndarray], draws: np.ndarray, seed: int, spread: float) -> np.ndarray:
    """The scale of each draw's residuals by the median of their distances from their median."""
    ranged = _ranged(rows, named)
    low, high = F.col("lo"), F.col("hi")
    m = draw_quantile(ranged, lambda b: _seen(b, named)["e"], low, high, 0.5, draws, seed, spread)
    from_, to = low - float(m.max()), high - float(m.min())
    return draw_quantile(ranged, lambda b: np.abs(_seen(b, named)["e"] - m), F.greatest(from_, -to, F.lit(0.0)), F.greatest(-from_, to), 0.5, draws, seed, spread) / 0.6745


def _stepped(
    rows: DataFrame, targets: list[str], named: dict[str, np.ndarray], limit: np.ndarray, draws: np.ndarray, seed: int, tolerance: float
) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Huber's estimator at a fixed limit by Newton's steps, and which draws seem to rest.

    A residual up to the limit counts as it is, one beyond as the limit, so rows that lie on one side of it in all draws are added up once;
    the others are looked at in each step. Where these are most of the rows, nothing is won and no step is made.
    """
    weigh, width = drawn(draws, seed), len(draws)

    def sure(own: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        w, side = weigh(own), own["side"][:, None]
        return w * (side == 0), w * np.where(side == 0, own["y"][:, None], limit * side)

    least, most, rest = float(limit.min()), float(limit.max()), np.zeros(width, dtype=bool)
    side = F.when(F.greatest(-F.col("lo"), F.col("hi")) <= least, 0).when(F.col("lo") > most, 1).when(F.col("hi") < -most, -1)
    marked = _ranged(rows, named, WIDER).withColumn("side", side)
    share = marked.agg(F.avg(F.col("side").isNull().cast("int"))).first()[0]
    if share is None or share > 0.5:
        return named, rest
    near = dealt(marked.where("side is null").drop("side"))
    plus = written(_sums(marked.where("side is not null"), sure, width, None, keep=("side",)), "sums")
    for _ in range(STEPS):
        new = fits(near, targets, _step(draws, seed, limit), width, named, plus=plus)
        rest = np.max([np.abs(new[f"t:{t}"] - named[f"t:{t}"]) for t in targets], axis=0) < tolerance
        named = named | new
        if rest.all():
            break
    return named, rest


def huber_draws(
    rows: DataFrame, targets: list[str], draws: np.ndarray, seed: int, *, tolerance: float = 1e-7, most: int = 1000, start: dict[str, np.ndarray] | None = None
) -> dict[str, np.ndarray]:
    """Huber's estimator on each draw, from least squares (``start``, if known). Coefficients by column, one a draw.

    Where rows are many, the draws lie close together, and Newton's steps look at few rows again (``_stepped``). What they find is held
    against a reweighing of all rows, which must leave it where it is. Draws that it moves are reweighed from the start until they rest: a
    pass reweighs all draws that haven't settled.
    """
    named, width = start or fits(rows, targets, drawn(draws, seed), len(draws)), len(draws)
    spread = _spread(rows)
    for k in range(2):
        limit = HUBER * _scales(rows, named, draws, seed, spread)
        found = named if k else named | fits(rows, targets, _step(draws, seed, limit), width, named)
        found, rest = _stepped(rows, targets, found, limit, draws, seed, tolerance)
        left = np.flatnonzero(rest)
        if len(left):
            now = {n: b[left] for n, b in found.items()}
            new = fits(rows, targets, _down(draws[left], seed, limit[left]), len(left), now)
            rest[left] = np.max([np.abs(new[f"t:{t}"] - now[f"t:{t}"]) for t in targets], axis=0) < tolerance
        named = {n: np.where(rest, found.get(n, 0.0), named.get(n, 0.0)) for n in named | found}
        left, last = np.flatnonzero(~rest), None
        for _ in range(most):
            if not len(left):
                break
            new = fits(rows, targets, _down(draws[left], seed, limit[left]), len(left), {n: b[left] for n, b in named.items()})
            for n, b in new.items():
                named.setdefault(n, np.zeros(width))[left] = b
            beta = np.array([new[f"t:{t}"] for t in targets])
            still = np.zeros(len(left), dtype=bool) if last is None else np.abs(beta - last).max(axis=0) < tolerance
            left, last = left[~still], beta[:, ~still]
        if len(left):
            raise RuntimeError("Huber's reweighting did not settle")
    return named


def _down(draws: np.ndarray, seed: int, limit: np.ndarray) -> Callable[[dict[str, np.ndarray]], np.ndarray]:
    """Weights of a reweighing for Huber's estimator: residuals beyond the limit weigh down."""
    weigh = drawn(draws, seed)
    return lambda own: weigh(own) * np.minimum(1.0, limit / np.maximum(np.abs(own["e"]), 1e-12))


def _step(draws: np.ndarray, seed: int, limit: np.ndarray) -> Callable[[dict[str, np.ndarray]], tuple[np.ndarray, np.ndarray]]:
    """Weights of a step of Newton's for Huber's estimator: residuals up to the limit as they are, the others as the limit."""
    weigh = drawn(draws, seed)

    def pulled(own: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        w, inside = weigh(own), np.abs(own["e"]) <= limit
        return w * inside, w * np.where(inside, own["y"][:, None], limit * np.sign(own["e"]))

    return pulled


def fit_all_draws(rows: DataFrame, *, draws: int = 999, seed: int = 20260909) -> DataFrame:
    """(draw, estimator, value): least squares, Huber and both trims of the contrast, all on the same draws.

    Rows that no draw trims are added up once; least squares and trims add what they have of the others.
    """
    targets, every = ["cf", "fc"], np.arange(draws)
    weigh, spread, rows = drawn(every, seed), _spread(rows), rows.select("x", "c", "w", "g")
    own = lambda b: b.column(b.schema.names.index("g")).to_numpy()[:, None]
    cuts = [draw_quantile(rows, own, F.col("g"), F.col("g"), s / 100, every, seed, spread) for pair in TRIMS.values() for s in pair]
    low, high = float(np.max(cuts[::2])), float(np.min(cuts[1::2]))
    core = F.coalesce(F.col("g").between(low, high), F.lit(False))
    plus, others = written(_sums(rows.where(core), weigh, draws, None), "sums"), dealt(rows.where(~core))
    found = {"ols": fits(others, targets, weigh, draws, plus=plus)}
    for k, name in enumerate(TRIMS):
        low, high = cuts[2 * k], cuts[2 * k + 1]
        inside = lambda own, low=low, high=high: weigh(own) * ((own["g"][:, None] >= low) & (own["g"][:, None] <= high))
        found[name] = fits(others, targets, inside, draws, plus=plus)
    found["huber"] = huber_draws(rows, targets, every, seed, start=found["ols"])
    out = [(d, name, float(v)) for name, b in found.items() for d, v in enumerate(0.5 * (b["t:cf"] - b["t:fc"]))]
    return rows.sparkSession.createDataFrame(out, "draw int, estimator string, value double")


def screened(pairs: DataFrame, masks: dict[str, Column], area: str, cluster: str, *, draws: int = 999, seed: int = 20260909) -> DataFrame:
    """``bootstrap`` of the contrast on each screen of the pairs, with the same draws, from one pass.

    Products are summed apart for each combination of screens that occurs (a bit a screen); a screen adds those with its bit.
    """
    bits = F.lit(0)
    for k, mask in enumerate(masks.values()):
        bits = bits + F.when(F.coalesce(mask, F.lit(False)), 1 << k).otherwise(0)
    rows = rows_of(pairs.withColumn("mask", bits), area, cluster, keep=["mask"])
    sums = _sums(rows, drawn(np.arange(draws), seed), draws, None, mask="mask")
    own = [F.when(F.col("mask").bitwiseAND(1 << k) > 0, name) for k, name in enumerate(masks)]
    sums = sums.withColumn("screen", F.explode(F.array_compact(F.array(*own))))
    sums = sums.groupBy("screen", "block", "i", "j").agg(*[F.sum(c).alias(c) for c in sums.columns if c[0] == "s" and c[1:].isdigit()])
    return _contrasts(sums, ["screen", "block"], {"": ("cf", "fc")}, draws)


def index_draws(rows: DataFrame, group: str, *, draws: int, seed: int = 20260909) -> DataFrame:
    """(draw, grp, n, mean): mean residuals by group of an index that is fitted anew on all rows of each draw.

    No residual is formed: a mean of y - Xb over a group is its sum of y less b times its sums of x, and these stand in the
    products once each row has an entry for its group.
    """
    mark = F.array(F.struct(F.concat(F.lit("g:"), F.col(group)).alias("k"), F.lit(1.0).alias("v")))
    index = F.filter("x", lambda e: ~e["k"].startswith("t:"))
    sums = _sums(rows.withColumn("x", F.when(F.col(group).isNull(), index).otherwise(F.concat(index, mark))), drawn(np.arange(draws), seed), draws, None)

    def fitted(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for draw, names, full in _systems(part, draws):
            at = {n: k for k, n in enumerate(names)}
            nuisance = [k for n, k in at.items() if n != "y" and not n.startswith("g:")]
            b = inverse(full[np.ix_(nuisance, nuisance)]) @ full[nuisance, at["y"]]
            for n, k in at.items():
                if n.startswith("g:") and full[k, k] > 0:
                    out.append((draw, n[2:], full[k, k], (full[k, at["y"]] - full[k, nuisance] @ b) / full[k, k]))
        return pd.DataFrame(out, columns=["draw", "grp", "n", "mean"])

    return sums.groupBy("block").applyInPandas(fitted, "draw int, grp string, n double, mean double")


def index_contrasts(means: DataFrame, *, least: int = 0) -> DataFrame:
    """(segment, draw, value) of means by groups ``segment|arm``: half of cf less fc, where both arms have ``least`` pairs."""
    segment, arm = F.regexp_extract("grp", r"^(.*)\|", 1).alias("segment"), F.substring_index("grp", "|", -1)
    of = lambda a, c: F.max(F.when(arm == a, F.col(c)))
    out = means.groupBy(segment, "draw").agg((0.5 * (of("cf", "mean") - of("fc", "mean"))).alias("value"), F.least(of("cf", "n"), of("fc", "n")).alias("n"))
    return out.where(F.col("value").isNotNull() & (F.col("n") >= least)).drop("n")


def placebo(rows: DataFrame, value: str, key: str, *, draws: int, seed: int) -> DataFrame:
    """(draw, half_difference, asymmetry, cf, fc) of values whose labels are drawn by a hash of the key: what chance alone gives."""

    def given(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((4, draws))
        for b in slices(batches, CELLS // draws):
            e = b.column(1).to_numpy(zero_copy_only=False)
            cf = uniform(b.column(0).to_numpy(), np.arange(draws), seed) <= 0.5
            sums += np.stack([e @ cf, e @ ~cf, cf.sum(axis=0), (~cf).sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(draws, dtype=np.int32)), *[pa.array(c) for c in sums]], names=["draw", "a", "b", "m", "n"])

    parts = rows.where(F.col(value).isNotNull()).select(F.xxhash64(key).alias("k"), F.col(value).cast("double").alias("e")).mapInArrow(given, "draw int, a double, b double, m double, n double")
    s = parts.groupBy("draw").agg(*[F.sum(c).alias(c) for c in "abmn"])
    cf, fc = F.try_divide("a", "m"), F.try_divide("b", "n")
    return s.select("draw", (0.5 * (cf - fc)).alias("half_difference"), (cf + fc).alias("asymmetry"), F.col("m").cast("long").alias("cf"), F.col("n").cast("long").alias("fc"))


def split(pairs: DataFrame, flag: Column, area: str, cluster: str, **parameters) -> DataFrame:
    """``bootstrap`` of the contrast by a flag of the pair: four dummies in one fit."""
    own, other = F.coalesce(flag, F.lit(False)).cast("double"), (~F.coalesce(flag, F.lit(False))).cast("double")
    four = {"cf1": F.col("cf") * own, "fc1": F.col("fc") * own, "cf0": F.col("cf") * other, "fc0": F.col("fc") * other}
    rows = rows_of(pairs, area, cluster, extra=four)
    # the plain dummies are the sums of the four: they leave
    rows = rows.withColumn("x", F.filter("x", lambda e: ~e["k"].isin("t:cf", "t:fc")))
    return bootstrap(rows, {"flagged": ("cf1", "fc1"), "other": ("cf0", "fc0")}, **parameters)
