"""Mixing sources to target weights by a time-varying curriculum.

Every source has a weight; targets are shares of all words by weight, stopped at ``repeats`` times the source's size,
the excess reshared by weight. A source's weight moves over the training run: at time t in 0..1 its rate of demand is
``1 + slope * (2 t - 1)`` times its mean, and the integral ``D(t) = (1 - slope) t + slope t**2`` is its cumulative
demand as a share of its target. A source's documents, in the order of a hash of their id, lie one after another on its
line of words, and again for each repeat. A copy that lies at word ``c`` is read at the training position ``D^-1(c /
target)``; a copy that the demand reaches whole by the end of the run is taken, and what is left of the demand is
filled by the one copy whose size is nearest to it, if that brings the source nearer to its target. Documents are
range-sorted by position, and what a document gives to the mix is counted from its positions.

No row is joined to another row of its table. The line is known by the words of its buckets (a prefix of the hash, 4096
a source whatever the number of sources; texts meet it by a broadcast, or by salted keys where there are more sources
than one holds), within a bucket a document's place follows from the rest of its hash. Where the demand ends is searched in the one bucket of each source that it ends in, bucket by smaller
bucket, and needs only sizes and hashes; rows that are equal share a hash and are counted, not listed. So texts are
moved once, by the range sort.

Edge cases: null and empty texts have size 0, take nothing and are in no schedule; a null source is a source of its own
and sorts last; rows that repeat an id and a text are equal: a copy goes to one of them, and where the demand ends among
them they are numbered, so that the first take a copy more; a source without words has target 0; an empty table gives
an empty result. Other columns are kept by ``schedule`` and ``mix`` and not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, join_small, materialize, n_words, numbered

#: Hexadecimal digits of a key by which a bucket is cut into smaller ones.
DIGITS = 3
#: Buckets with up to this many different keys are put in order as a whole.
ROWS = 20_000


def targets(sizes: DataFrame, *, cycle: int = 3, repeats: int = 3) -> DataFrame:
    """``source``, ``source_size``, ``weight`` and ``target`` of each source, from rows of (source, size).

    The level of the uncapped sources is found by capping those above it until none is: each step sums the sources.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())  # one row per source
    weight = (F.row_number().over(order) - 1) % cycle + 1
    sources = materialize(sources.withColumn("weight", weight.cast("int")))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        free = (F.col("source_size") * repeats) > F.col("weight") * F.lit(level)
        r = sources.agg(
            F.sum(F.when(free, F.col("weight"))).alias("w"), F.sum(F.when(~free, F.col("source_size") * repeats)).alias("capped")
        ).first()
        # a source is free while its cap is above its share
        new = (total - (r["capped"] or 0)) / r["w"] if r["w"] else level
        if new <= level:
            break
        level = new
    target = F.least((F.col("source_size") * repeats).cast("double"), F.col("weight") * F.lit(level))
    return sources.withColumn("target", F.round(target, 6))


def key(doc_id: Column, text: Column, seed: int) -> Column:
    """The order of documents on the line of their source: a hash of the id that other engines have, then one of the text."""
    own = F.lower(F.lpad(F.hex(F.xxhash64(text)), 16, "0"))
    name = F.coalesce(doc_id.cast("string"), F.concat(F.lit("null "), F.xxhash64(text).cast("string")))
    return F.concat(F.md5(F.concat(F.lit(f"{seed}:"), name).cast("binary")), own)


def position(offset: Column, target: Column, slope: Column) -> Column:
    """The time at which the cumulative demand reaches ``offset``: the inverse of (1 - s) t + s t^2."""
    share = F.least(F.lit(1.0), offset / target)
    root = F.sqrt(F.pow(1 - slope, 2) + 4 * slope * share)
    return F.when(F.abs(slope) < 1e-9, share).otherwise((root - (1 - slope)) / (2 * slope))


@dataclass
class Curriculum:
    """What the demand makes of the sources.

    ``sources``: size, target, slope; ``epochs`` that every document is read; the key ``cut`` up to which the documents
    are read once more, and how many of its ``cut_rows`` equal rows are (``cut_first``); the key ``fill`` of the copy that
    fills what is ``left``, with its number of equal rows. ``lines``: offset and words of each bucket. ``numbered``: whether some equal rows are to be told apart.
    """

    sources: DataFrame
    lines: DataFrame
    numbered: bool


def _cumulated(rows: DataFrame, order: str) -> DataFrame:
    """Rows with ``offset``: the words of their source's rows before them."""
    before = Window.partitionBy("source").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum("words").over(before), F.lit(0)))


def curriculum(sizes: DataFrame, *, cycle: int = 3, repeats: int = 3) -> Curriculum:
    """From rows of (source, key, size), which are read several times: write them down before."""
    some = sizes.where("size > 0")
    words, equal = F.sum("size").cast("long").alias("words"), F.count("*").alias("n")
    lines = materialize(sizes.groupBy("source", F.substring("key", 1, DIGITS).alias("bucket")).agg(words, equal))
    shares = targets(lines.select("source", F.col("words").alias("size")), cycle=cycle, repeats=repeats)
    room, size = F.floor(F.col("target") + 1e-6), F.nullif("source_size", F.lit(0))
    shares = shares.withColumn("epochs", F.coalesce(F.least(F.lit(repeats), F.floor(room / size)), F.lit(0)).cast("int"))
    rest = F.when((F.col("epochs") < repeats) & (F.col("source_size") > 0), room - F.col("epochs") * F.col("source_size"))
    slope = ((2 * F.col("weight") - (cycle + 1)) / F.lit(max(cycle - 1, 1)) * 0.5).cast("double")
    shares = shares.withColumns({"slope": slope, "rest": rest, "room": room})
    n_sources = shares.count()

    # the bucket in which the demand of the last epoch ends, and smaller ones while they hold many keys
    ends = (F.col("offset") <= F.col("rest")) & (F.col("rest") < F.col("offset") + F.col("words"))
    within = lambda rows, at: join_small(rows, at, ["source"], rows=n_sources)
    remaining = (F.col("rest") - F.col("offset")).alias("rest")
    at = within(_cumulated(lines, "bucket"), shares.select("source", "rest")).where(ends)
    at = materialize(at.select("source", F.col("bucket").alias("prefix"), remaining, "n"))
    digits = DIGITS
    while True:
        inside = within(some, at.select("source", "prefix", "rest")).where(F.substring("key", 1, digits) == F.col("prefix"))
        if (at.agg(F.max("n")).first()[0] or 0) <= ROWS or digits >= 48:
            break
        most = inside.groupBy("source").agg(F.approx_count_distinct("key").alias("keys")).agg(F.max("keys")).first()[0] or 0
        if most <= ROWS:
            break
        digits += DIGITS
        smaller = inside.groupBy("source", "rest", F.substring("key", 1, digits).alias("prefix")).agg(words, equal)
        at = materialize(_cumulated(smaller, "prefix").where(ends).select("source", "prefix", remaining, "n"))
    groups = inside.groupBy("source", "rest", "key").agg(words, equal, F.max("size").alias("size"))
    cut = _cumulated(groups, "key").where(ends)
    first = F.floor((F.col("rest") - F.col("offset")) / F.col("size"))
    left = F.col("rest") - F.col("offset") - first * F.col("size")
    cut = cut.select("source", F.col("key").alias("cut"), first.alias("cut_first"), F.col("n").alias("cut_rows"), left.alias("left"))
    shares = materialize(within(shares.drop("rest"), cut))

    # the copy that fills what is left; of equal rows the last, which is read least
    gap, often = F.abs(F.col("left") - F.col("size")), F.col("epochs") + F.when(F.col("key") < F.col("cut"), 1).otherwise(0)
    fits = within(some, shares.select("source", "epochs", "cut", "left")).where((often < repeats) & (gap < F.col("left")))
    fill = fits.groupBy("source").agg(F.min(F.struct(gap.alias("gap"), "key")).alias("b")).select("source", F.col("b.key").alias("fill"))
    n_fill = within(some, fill).where(F.col("key") == F.col("fill")).groupBy("source", "fill").agg(F.count("*").alias("fill_rows"))
    shares = materialize(within(shares, n_fill))
    numbered = shares.where("cut_first > 0 or fill_rows > 1").limit(1).count() > 0
    return Curriculum(shares, _cumulated(lines, "bucket"), numbered)


def placed(rows: DataFrame, plan: Curriculum) -> DataFrame:
    """Rows of (source, ``__key``, ``__some``: whether there are words) with ``__positions``, that of each copy taken.

    Also ``__source_size`` and ``__target``.
    """
    facts = ("source_size", "target", "slope", "room", "epochs", "cut", "cut_first", "cut_rows", "left", "fill", "fill_rows")
    own = plan.sources.select("source", *[F.col(c).alias(f"__{c}") for c in facts])
    rows = join_small(rows, own, ["source"])
    at_cut = F.col("__some") & (F.col("__key") == F.col("__cut")) & (F.col("__cut_first") > 0)
    at_fill = F.col("__some") & (F.col("__key") == F.col("__fill"))
    if plan.numbered:
        several = F.coalesce(at_cut, F.lit(False)) | F.coalesce(at_fill & (F.col("__fill_rows") > 1), F.lit(False))
        # the plain rows stay where they are; only equal rows at the end of a demand are written down and numbered
        rows = rows.where(~several).withColumn("__nth", F.lit(0).cast("long")).unionByName(numbered(rows.where(several), ["source", "__key"]))
    else:
        rows = rows.withColumn("__nth", F.lit(0).cast("long"))
    once_more = F.when(F.col("__key") < F.col("__cut"), 1).when(at_cut & (F.col("__nth") < F.col("__cut_first")), 1).otherwise(0)
    epochs = F.when(F.col("__some"), F.col("__epochs") + once_more).otherwise(0)
    filling = at_fill & (F.col("__nth") == F.col("__fill_rows") - 1)
    line = plan.lines.select("source", F.col("bucket").alias("__bucket"), F.col("offset").alias("__offset"), F.col("words").alias("__words"))
    rows = join_small(rows.withColumn("__bucket", F.substring("__key", 1, DIGITS)), line, ["source", "__bucket"])
    share = F.conv(F.substring("__key", DIGITS + 1, 8), 16, 10).cast("double") / float(1 << 32)
    place = F.col("__offset") + share * F.col("__words")
    read = lambda c: position(c, F.col("__target"), F.col("__slope"))
    every = F.transform(F.sequence(F.lit(0), epochs - 1), lambda e: read(place + e * F.col("__source_size")))
    none = F.array().cast("array<double>")
    rows = rows.withColumn(
        "__positions",
        F.concat(F.when(epochs > 0, every).otherwise(none), F.when(filling, F.array(read(F.col("__room") - F.col("__left")))).otherwise(none)),
    )
    return rows.drop("__bucket", "__offset", "__words", "__nth", *[f"__{c}" for c in facts if c not in ("source_size", "target")])


def _sizes(documents: DataFrame, seed: int, *more: str) -> DataFrame:
    return materialize(documents.select(*more, "source", key(F.col("doc_id"), F.col("text"), seed).alias("key"), n_words(F.col("text")).alias("size")))


def digest(documents: DataFrame, *, cycle: int = 3, repeats: int = 3, seed: int = 7) -> DataFrame:
    """``doc_id``, ``size``, ``source_size``, ``target`` and ``taken`` of every document, in the order of the training.

    Also ``copies`` that training reads and the ``first_position`` at which it does (null where there are none).
    """
    sizes = _sizes(documents, seed, "doc_id")
    rows = sizes.withColumn("__some", F.col("size") > 0).withColumnRenamed("key", "__key")
    rows = placed(rows, curriculum(sizes, cycle=cycle, repeats=repeats))
    copies, first = F.size("__positions").cast("long"), F.get("__positions", F.lit(0))
    own = [F.col(f"__{c}").alias(c) for c in ("source_size", "target")]
    rows = rows.orderBy(first.asc_nulls_last(), "doc_id")
    return rows.select("doc_id", "size", *own, (F.col("size") * copies).alias("taken"), copies.alias("copies"), F.round(first, 6).alias("first_position"))


def schedule(documents: DataFrame, *, cycle: int = 3, repeats: int = 3, seed: int = 7) -> DataFrame:
    """The documents as training reads them: a row per copy taken, range-sorted by ``__position`` in 0..1.

    The schedules follow the weights: sources of the smallest weight are asked for early, of the largest late.
    """
    plan = curriculum(_sizes(documents, seed), cycle=cycle, repeats=repeats)
    words = F.coalesce(F.col("text").rlike(WORD), F.lit(False)).alias("__some")
    whole = F.struct(*documents.columns).alias("row")  # no name of theirs meets one of these
    rows = documents.select(whole, "source", key(F.col("doc_id"), F.col("text"), seed).alias("__key"), words)
    rows = placed(rows, plan).select("row", F.posexplode("__positions").alias("__epoch", "__position"))
    return rows.orderBy("__position", "row.doc_id", "__epoch").select("row.*", "__epoch", "__position")


def mix(documents: DataFrame, **parameters) -> DataFrame:
    """``schedule`` with the documents' own columns alone."""
    return schedule(documents, **parameters).drop("__epoch", "__position")
