"""SimHash near-duplicates by a segment-popcount embedding.

Fingerprints are 64-bit majority votes over the XXH64 values of three-word shingles. A fingerprint is embedded as the
bit counts of its 32 two-bit segments; the Manhattan distance of two embeddings never exceeds the Hamming distance of
the fingerprints, so it is a lower bound that a link must meet. The coordinates are cut into ``bands`` groups: points
within distance ``radius`` differ in at most ``radius`` groups and so agree in all coordinates of some
``bands - radius`` of them. Each such choice of groups is a grid whose cells hold equal coordinates, and a link is
found in the cell of at least one grid. Within a cell the Manhattan bound is applied, then the exact Hamming distance.

Work is done on distinct fingerprints. A cell yields a spanning forest of its links, never all its pairs: the members
are searched breadth first, and what has been reached leaves the search. Cells that grow beyond ``block`` members with
the table are cut again by a grid over their other coordinates, in the same way: these fall into five groups, and points
within the radius agree in two of them. A cell that is crowded even then holds points alike in most coordinates; it is
cut into blocks and dealt as pairs of blocks, so no task holds an unbounded cell. Components come from alternating
large-star and small-star steps over the forest's edges; each step is written to the shared folder.

Edge cases: null, empty and white-space-only texts have the fingerprint zero and link like any other; texts of one or
two words have one shingle, the whole sequence. Rows with a null doc_id get a fingerprint and belong to the component
of their fingerprint; a component of such rows alone has the id null. Repeated ids and rows are returned as often as
they come. An empty table gives an empty result. Other columns of the input are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_ROWS, materialize, numbered

CHUNK = 1 << 14
SHIFTS = np.arange(64, dtype=np.uint64)


def fingerprint(text: str | None) -> int:
    """Majority vote of each bit over the hashes of all three-word shingles, repeats included; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < 3:
        return digest(b" ".join(words), 42)
    shingles = map(b"%b %b %b".__mod__, zip(words, words[1:], words[2:], strict=False))
    hashes = np.fromiter((digest(s, 42) for s in shingles), dtype="<u8", count=len(words) - 2)
    votes = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), CHUNK):  # bounds the unpacked bits of a very long text
        part = hashes[i : i + CHUNK]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(((2 * votes > len(hashes)).astype(np.uint64) << SHIFTS).sum(dtype=np.uint64))


@F.pandas_udf(T.LongType())
def fingerprint_of(texts: pd.Series) -> pd.Series:
    """The fingerprint's bits as a signed long, as Spark has no unsigned one."""
    return pd.Series(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64))


def embed(fp: np.ndarray) -> np.ndarray:
    """Bit counts of the two-bit segments, each left in the two bits of its segment."""
    odd = np.uint64(0x5555555555555555)
    return (fp & odd) + ((fp >> np.uint64(1)) & odd)


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of packed embeddings: per segment |a - b| for counts of 0 to 2."""
    odd = np.uint64(0x5555555555555555)
    a_low, a_high, b_low, b_high = a & odd, (a >> np.uint64(1)) & odd, b & odd, (b >> np.uint64(1)) & odd
    # counts 0 and 2 differ by 2 where the high bits differ and both low bits are clear; any other difference is 1
    two = (a_high ^ b_high) & ~(a_low | b_low)
    one = (a_low ^ b_low) & odd
    return 2 * np.bitwise_count(two).astype(np.int16) + np.bitwise_count(one)


def _split(segments: list[int], parts: int) -> list[int]:
    """Masks of the segments' bits in ``parts`` groups of neighbouring segments."""
    edges = np.linspace(0, len(segments), parts + 1).astype(int)
    return [sum(3 << (2 * s) for s in segments[a:b]) for a, b in zip(edges, edges[1:], strict=False)]


def _mixed(x: np.ndarray, seed: np.ndarray | int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + seed
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def cells(fp: np.ndarray, bands: int, radius: int) -> np.ndarray:
    """Cell numbers (points x grids): a hash of the grid and of the coordinates that the grid keeps."""
    points = embed(fp)
    grids = combinations(_split(list(range(32)), bands), bands - radius)
    out = [_mixed(points & np.uint64(sum(g)), np.uint64(n * 0xC2B2AE3D27D4EB4F % 2**64)) for n, g in enumerate(grids)]
    return np.stack(out, axis=1).view(np.int64)


def finer(fp: np.ndarray, cell: np.ndarray, grid: np.ndarray, bands: int, radius: int, parts: int) -> np.ndarray:
    """Cell numbers (points x finer grids) within crowded cells of the given grids.

    Points of a cell agree in the coordinates that its grid keeps. The others are cut into ``parts`` groups, of which
    points within the radius agree in all but ``radius`` again.
    """
    points, out = embed(fp), np.zeros((len(fp), math.comb(parts, radius)), dtype=np.uint64)
    groups = _split(list(range(32)), bands)
    for g, chosen in enumerate(combinations(groups, bands - radius)):
        mine = grid == g
        if mine.any():
            rest = [s for s in range(32) if not sum(chosen) >> (2 * s) & 1]
            for n, kept in enumerate(combinations(_split(rest, parts), parts - radius)):
                seed = cell[mine].view(np.uint64) + np.uint64((n + 1) * 0xD6E8FEB86659FD93 % 2**64)
                out[mine, n] = _mixed(points[mine] & np.uint64(sum(kept)), seed)
    return out.view(np.int64)


def forest(left: np.ndarray, right: np.ndarray | None, radius: int) -> list[tuple[int, int]]:
    """Edges that connect what links of at most ``radius`` bits connect, among ``left`` or between left and right.

    Breadth first: a point is compared with the points that no search has reached yet, so a dense group costs about
    its size, not its square.
    """
    edges: list[tuple[int, int]] = []
    rest = [left, right if right is not None else left]
    both = right is not None

    def near(x: np.uint64, others: np.ndarray) -> np.ndarray:
        close = manhattan(embed(others), embed(np.full(1, x, np.uint64))) <= radius
        close[close] = np.bitwise_count(others[close] ^ x) <= radius
        return close

    while len(rest[0]) and (both or len(rest[0]) > 1):
        frontier = [(rest[0][0], 0)]
        rest[0] = rest[0][1:]
        while frontier:
            x, side = frontier.pop()
            other = 1 - side if both else 0
            hit = near(x, rest[other])
            for y in rest[other][hit]:
                edges.append((int(x), int(y)))
                frontier.append((y, other))
            rest[other] = rest[other][~hit]
        if both and not len(rest[1]):
            break
    return edges


def linked(batches: Iterator[pd.DataFrame], radius: int) -> Iterator[pd.DataFrame]:
    """Forest edges of each run of rows with one (cell, i, j); the rows come sorted by these."""
    held: list[pd.DataFrame] = []

    def runs(part: pd.DataFrame) -> Iterator[tuple[int, int]]:
        key = part[["cell", "i", "j"]].to_numpy()
        cut = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        bounds = np.concatenate([[0], cut, [len(part)]])
        long = np.flatnonzero(np.diff(bounds) > 1)
        yield from zip(bounds[long], bounds[long + 1], strict=True)

    def found(part: pd.DataFrame) -> pd.DataFrame:
        fp, own = part["fp"].to_numpy().view(np.uint64), part["own"].to_numpy()
        i, j = part["i"].to_numpy(), part["j"].to_numpy()
        edges: list[tuple[int, int]] = []
        for a, b in runs(part):
            if i[a] == j[a]:
                edges += forest(fp[a:b], None, radius)
            else:
                mine = own[a:b] == i[a]
                edges += forest(fp[a:b][mine], fp[a:b][~mine], radius)
        return pd.DataFrame(np.array(edges, dtype=np.uint64).reshape(-1, 2).view(np.int64), columns=["a", "b"])

    for batch in batches:
        if not len(batch):
            continue
        key = batch[["cell", "i", "j"]].to_numpy()
        last = np.flatnonzero((key != key[-1]).any(axis=1))
        cut = last[-1] + 1 if len(last) else 0
        if cut:
            yield found(pd.concat([*held, batch[:cut]]) if held else batch[:cut])
            held = [batch[cut:]]
        elif held and (held[0][["cell", "i", "j"]].iloc[0].to_numpy() != key[0]).any():
            yield found(pd.concat(held))
            held = [batch]
        else:
            held.append(batch)
    if held:
        yield found(pd.concat(held))


def _crowded(points: DataFrame, block: int) -> DataFrame:
    """(__c, blocks) of the cells of more than ``block`` points."""
    counts = points.groupBy("cell").count().where(F.col("count") > block)
    return materialize(counts.select(F.col("cell").alias("__c"), F.ceil(F.col("count") / block).cast("int").alias("blocks")))


def _with_blocks(points: DataFrame, crowded: DataFrame, n: int) -> DataFrame:
    side = F.broadcast(crowded) if n <= BROADCAST_ROWS else crowded
    return points.join(side, F.col("cell") == F.col("__c"), "left").drop("__c").withColumn("blocks", F.coalesce("blocks", F.lit(1)))


def gridded(fingerprints: DataFrame, *, radius: int = 3, bands: int = 6, block: int = 4096, parts: int = 5) -> DataFrame:
    """(fp, cell, own, i, j): where points meet, so that every link meets in a cell (i, j) of at most 2 ``block`` points.

    Cells that grow beyond ``block`` points with the table are cut by a finer grid; what is still crowded then holds
    points that agree in most coordinates, and is dealt as pairs of blocks.
    """
    grids = F.pandas_udf(lambda s: pd.Series(list(cells(s.to_numpy().view(np.uint64), bands, radius))), T.ArrayType(T.LongType()))
    points = fingerprints.select("fp", F.posexplode(grids("fp")).alias("grid", "cell"))
    crowded = _crowded(points, block)
    n_crowded, zero = crowded.count(), F.lit(0)
    alone = lambda p: p.select("fp", "cell", zero.alias("own"), zero.alias("i"), zero.alias("j"))
    if not n_crowded:
        return alone(points)

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def split(fp: pd.Series, cell: pd.Series, grid: pd.Series) -> pd.Series:
        own = [x.to_numpy() for x in (fp, cell, grid)]
        return pd.Series(list(finer(own[0].view(np.uint64), own[1], own[2], bands, radius, parts)))

    points = _with_blocks(points, crowded, n_crowded)
    inner = points.where("blocks > 1").select("fp", F.explode(split("fp", "cell", "grid")).alias("cell"))
    points, still = alone(points.where("blocks = 1")), _crowded(inner, block)
    n_still = still.count()
    if not n_still:
        return points.unionByName(alone(inner))
    inner = _with_blocks(inner, still, n_still)
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    inner = inner.withColumn("own", own).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return points.unionByName(inner.select("fp", "cell", "own", F.least("own", "k").alias("i"), F.greatest("own", "k").alias("j")))


def links(fingerprints: DataFrame, *, radius: int = 3, bands: int = 6, block: int = 4096) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column ``fp``) that join all that links join."""
    points = gridded(fingerprints, radius=radius, bands=bands, block=block).select("cell", "fp", "own", "i", "j")
    dealt = points.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")
    return dealt.mapInPandas(lambda batches: linked(batches, radius), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each id of the edges (a, b) reaches.

    Large-star and small-star steps in turn, until the edges are stars around each component's smallest id.
    """
    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    seen = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        star = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        star = star.union(least.where("m < a").select("a", F.col("m").alias("b"))).distinct()
        low = star.groupBy("a").agg(F.min("b").alias("m"))
        small = star.join(low, "a").select(F.col("b").alias("x"), "m").where("x <> m").union(low.select("a", "m"))
        edges = materialize(small.select(F.col("x").alias("a"), F.col("m").alias("b")).distinct())
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
        if state == seen:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
        seen = state


def _placed(prints: DataFrame, **parameters) -> DataFrame:
    """For each distinct fingerprint ``__fp``: its component's smallest doc_id and the fingerprint of that document."""
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    found = materialize(components(links(classes, **parameters)))
    placed = classes.join(found, F.col("fp") == F.col("id"), "left").select("fp", "rep", F.coalesce("component", "fp").alias("c"))
    first = placed.groupBy("c").agg(F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "fp")).alias("first"))
    return placed.join(first, "c").select(
        F.col("fp").alias("__fp"), F.col("first.rep").alias("component_id"), F.col("first.fp").alias("first_fp")
    )


def near_duplicates(documents: DataFrame, *, radius: int = 3, bands: int = 6, block: int = 4096) -> DataFrame:
    """``doc_id``, ``fingerprint`` (hexadecimal) and ``component_id`` of every document."""
    prints = materialize(documents.select("doc_id", fingerprint_of("text").alias("fp")))
    out = prints.join(_placed(prints, radius=radius, bands=bands, block=block), F.col("fp") == F.col("__fp"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(documents: DataFrame, *, radius: int = 3, bands: int = 6, block: int = 4096) -> DataFrame:
    """One document of each component, with its own columns: that of the smallest doc_id.

    Of rows that repeat that id and fingerprint, those of the smallest hash of the text are kept, and one of them if
    there are more. The choice is made on ids and hashes; texts are read once more and joined to it.
    """
    prints = materialize(documents.select("doc_id", F.xxhash64("text").alias("h"), fingerprint_of("text").alias("fp")))
    first = _placed(prints, radius=radius, bands=bands, block=block).where("__fp = first_fp").drop("first_fp")
    same = (F.col("fp") == F.col("__fp")) & F.col("doc_id").eqNullSafe(F.col("component_id"))
    rows = prints.join(first, same, "left_semi").groupBy("fp", "doc_id", "h").agg(F.count("*").alias("n"))
    kept = rows.groupBy("fp", "doc_id").agg(F.min(F.struct("h", "n")).alias("m"))
    kept = materialize(kept.select(F.col("doc_id").alias("id"), "m.h", "m.n"))
    rows, most = kept.agg(F.count("*"), F.max("n")).first()
    whole = documents.select(F.struct(*documents.columns).alias("row"))  # no name of theirs meets one of these
    same = (F.xxhash64("row.text") == F.col("h")) & F.col("row.doc_id").eqNullSafe(F.col("id"))
    out = whole.join(F.broadcast(kept) if rows <= BROADCAST_ROWS else kept, same)
    if (most or 0) > 1:
        several = numbered(out.where("n > 1"), ["id", "h"]).where("__nth = 0")
        out = out.where("n = 1").unionByName(several.drop("__nth"))
    return out.select("row.*")
