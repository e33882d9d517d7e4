"""Joins between dated records: intervals, nearest, as-of, uniqueness both ways.

Every band join carries an equality on the key, so it is planned as a hash or sort-merge join with a residual
condition, and hot keys are split by adaptive execution. Rules about ties count distinct documents; none picks a row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .pairing import rolling_count
from .scan import scanned

BROADCAST_ROWS = 100_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint, if the side has at most ``rows`` rows (looks at one row more than that)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{prefix}{c}") for c in df.columns])


def band(
    left: DataFrame, right: DataFrame, keys: list[str], day: str, other_day: str, low: int, high: int, how: str = "left"
) -> DataFrame:
    """Rows of both sides with equal keys whose days differ by ``low`` to ``high`` (inclusive); right columns get ``r_``.

    A column ``gap`` holds the days from the left to the right date.
    """
    r = _prefixed(right, "r_")
    gap = F.datediff(F.col(f"r_{other_day}"), F.col(day))
    on = [F.col(k) == F.col(f"r_{k}") for k in keys] + [gap.between(low, high)]
    out = left.join(r, on, how)
    return out if how in ("left_semi", "left_anti") else out.withColumn("gap", gap)


def window_flags(
    sales: DataFrame, filings: DataFrame, windows: dict[str, tuple[int, int]], *, key: str = "bbl", day: str = "sale_date",
    filing_day: str = "doc_date", amount: str = "amount", amount_in: str | None = None,
) -> DataFrame:
    """Sales with ``financed_<name>`` for each window in days, from one join with the widest band.

    With ``amount_in`` also ``mort_amt``: the largest amount in that window, 0 without one. Flags are found once for each
    key and day and joined back, so equal sales stay as many as they are and a key has a calendar's days at most. Days meet
    by spans as long as the widest band, so a key's sales and filings that lie years apart don't.
    """
    low, high = min(a for a, _ in windows.values()), max(b for _, b in windows.values())
    number = lambda day: F.floor(F.datediff(day, F.lit("1970-01-01").cast("date")) / (high - low + 1))
    spans = F.explode(F.sequence(number(F.date_add(day, low)), number(F.date_add(day, high)))).alias("__span")
    own = sales.select(key, day).where(F.col(key).isNotNull() & F.col(day).isNotNull()).distinct().select("*", spans)
    other = filings.select(key, filing_day, *([amount] if amount_in else [])).withColumn("__span", number(F.col(filing_day)))
    hits = band(own, other, [key, "__span"], day, filing_day, low, high, "inner")
    inside = {n: F.col("gap").between(a, b) for n, (a, b) in windows.items()}
    flags = {f"financed_{n}": (F.max(F.when(x, 1)), 0) for n, x in inside.items()}
    if amount_in:
        flags["mort_amt"] = (F.max(F.when(inside[amount_in], F.col(f"r_{amount}"))), 0.0)
    found = hits.groupBy(F.col(key).alias("__key"), F.col(day).alias("__day")).agg(*[f.alias(n) for n, (f, _) in flags.items()])
    out = sales.join(found, (F.col(key) == F.col("__key")) & (F.col(day) == F.col("__day")), "left").drop("__key", "__day")
    return out.withColumns({n: F.coalesce(n, F.lit(none)) for n, (_, none) in flags.items()})


def exists_between(left: DataFrame, right: DataFrame, key: str, low: str, high: str, day: str, *, negate: bool = False) -> DataFrame:
    """Left rows with (or, negated, without) a right row of the same key between two of their days, inclusive."""
    r = _prefixed(right.select(key, day), "r_")
    on = (F.col(key) == F.col(f"r_{key}")) & F.col(f"r_{day}").between(F.col(low), F.col(high))
    return left.join(r, on, "left_anti" if negate else "left_semi")


def flag_between(left: DataFrame, right: DataFrame, key: str, low: str, high: str, day: str, name: str) -> DataFrame:
    """Left rows with a boolean: is there a right row of the key between two of their days, inclusive?

    An existence join: no row of either side is multiplied or gathered.
    """
    sql = f"""select l.*, exists (select 1 from {{right}} r where r.`{key}` = l.`{key}` and r.`{day}` between l.`{low}` and l.`{high}`) as `{name}`
        from {{left}} l"""
    return left.sparkSession.sql(sql, left=left, right=right)


def nearest_unique(
    sales: DataFrame, documents: DataFrame, *, sale: str = "sale_id", key: str = "bbl", day: str = "sale_date", doc: str = "doc_id",
    doc_day: str = "doc_date", within: int = 45,
) -> DataFrame:
    """The one document nearest in days, per sale: ``doc``, ``nearest_gap`` and ``nearest_ties``.

    Where several distinct documents share the least gap the document is null; one document listed twice is one.
    """
    hits = band(sales.select(sale, key, day), documents.select(key, doc, doc_day), [key], day, doc_day, -within, within)
    gap = F.abs("gap")
    # the least (gap) and the documents at it come from one aggregation: per gap first, then the smallest
    by_gap = hits.groupBy(sale, gap.alias("g")).agg(F.count_distinct(f"r_{doc}").alias("ties"), F.min(f"r_{doc}").alias("doc"))
    best = by_gap.groupBy(sale).agg(F.min_by(F.struct("g", "ties", "doc"), F.col("g")).alias("b"))
    ties = F.coalesce("b.ties", F.lit(0)).cast("long")
    return best.select(
        sale, F.when(ties == 1, F.col("b.doc")).alias(doc), F.col("b.g").alias("nearest_gap"), ties.alias("nearest_ties")
    )


def unique_match(
    sales: DataFrame, documents: DataFrame, *, sale: str = "sale_id", keys: list[str], day: str = "sale_date", doc_day: str = "doc_date",
    price: str = "price", amount: str = "amount", target: str = "doc_id", within: int = 45, share: float = 0.005,
) -> DataFrame:
    """Sales matched on keys, date and amount if exactly one distinct ``target`` agrees; ``reason`` says why not.

    With a lot as the target two deeds of one lot still match; with a document they don't. Few keys may have many rows: whether any
    document has the date is found for each key and day, and only rows of neighbouring spans of days and of log amounts meet;
    of a sale's targets the first and the last are kept, in the task that meets them.
    """
    width, since = 2 * within + 1, F.lit("1970-01-01").cast("date")
    number = lambda day: F.floor(F.datediff(day, since) / width)
    own, columns = sales.select(sale, *keys, day, price), list(dict.fromkeys([*keys, doc_day, amount, target]))
    spans = F.explode(F.sequence(number(F.date_sub(day, within)), number(F.date_add(day, within)))).alias("__span")
    documents = documents.select(*columns).withColumn("__span", number(F.col(doc_day)))
    days = band(own.select(*keys, day).distinct().select("*", spans), documents.select(*keys, doc_day, "__span").distinct(), [*keys, "__span"], day, doc_day, -within, within, "left_semi")
    days = days.select(*[F.col(k).alias(f"__{i}") for i, k in enumerate(keys)], F.col(day).alias("__day")).distinct()
    dated = own.join(days, [*[F.col(k) == F.col(f"__{i}") for i, k in enumerate(keys)], F.col(day) == F.col("__day")], "left")

    # prices that any amount is near to by the rule (NaN, infinity) look everywhere
    any_ = F.isnan(F.col(price).cast("double")) | (F.col(price).cast("double") == float("inf"))
    step = math.log((1 + share) / (1 - share)) if 0 < share < 1 else 1.0
    at = lambda x, shift=0.0: F.when(x > 0, F.floor(F.log(x.cast("double")) / step + shift)).otherwise(F.lit(-(1 << 40)))
    low, high = (at(F.col(price) * (1 + side * min(share, 1.0)), side * 1e-6) for side in (-1, 1))
    near = F.explode(F.sequence(low, high)) if share < 1 else F.lit(0)
    some = own.where(~any_).select("*", near.alias("__near")).select("*", spans)
    right = documents.withColumn("__near", at(F.col(amount)) if share < 1 else F.lit(0))
    hits = band(some, right, [*keys, "__span", "__near"], day, doc_day, -within, within, "inner").unionByName(
        band(own.where(any_).select("*", F.lit(0).alias("__near")).select("*", spans), right.withColumn("__near", F.lit(0)), [*keys, "__span"], day, doc_day, -within, within, "inner")
    )
    hits = hits.where(F.abs(F.col(f"r_{amount}") - F.col(price)) <= share * F.col(price))
    none = F.lit(None).cast(documents.schema[target].dataType)
    every = dated.select(sale, F.col("__day").isNotNull().alias("dated"), none.alias("t")).unionByName(
        hits.select(sale, F.lit(False).alias("dated"), F.col(f"r_{target}").alias("t"))
    )
    found = every.groupBy(sale).agg(F.min("t").alias("t"), F.max("t").alias("last"), F.max("dated").alias("dated"))
    one = F.col("t") == F.col("last")
    reason = F.when(one, "matched").when(~one, "ambiguous").when(F.col("dated"), "no amount").otherwise("no date")
    return found.select(sale, F.when(one, F.col("t")).alias(target), reason.alias("reason"))


def as_of(left: DataFrame, right: DataFrame, day: str, right_day: str, value: str, *, keys: list[str] | None = None) -> DataFrame:
    """Left rows with ``value`` of the latest right row on or before their day (null before the first).

    Dates are days, so without keys the right side comes down to a calendar: one row per day, filled forward, some
    36,500 rows a century whatever the data, and the join is an equality. With keys both sides are put in one order per
    key and the last value is carried forward, by a scan in two levels, so a hot key takes many tasks. Neither side is
    multiplied. Of right rows of one day the largest value counts; right rows without a day count for nothing.
    """
    if keys:
        marked = left.withColumns({"__day": F.col(day), "__side": F.lit(1), "__value": F.lit(None).cast(right.schema[value].dataType)})
        dated = right.where(F.col(right_day).isNotNull())
        other = dated.groupBy(*keys, F.col(right_day).alias("__day")).agg(F.max(value).alias("__value")).withColumn("__side", F.lit(0))
        every = marked.unionByName(other, allowMissingColumns=True)
        out = scanned(every, keys, ["__day", "__side"], latest={value: "__value"})
        return out.where("__side = 1").drop("__day", "__side", "__value")
    daily = right.where(F.col(right_day).isNotNull()).groupBy(F.col(right_day).alias("__a")).agg(F.max(value).alias("__v"))
    daily = daily.withColumn("__next", F.lead("__a").over(Window.orderBy("__a")))  # a row per day at most
    last = daily.where("__next is null").first()
    if last is None:
        return left.withColumn(value, F.lit(None).cast(right.schema[value].dataType))
    days = F.explode(F.sequence("__a", F.date_sub("__next", 1)))
    filled = daily.where("__next is not null").select(days.alias("__d"), "__v")
    out = left.join(small(filled), F.col(day) == F.col("__d"), "left")
    return out.withColumn(value, F.when(F.col(day) >= F.lit(last["__a"]), F.lit(last["__v"])).otherwise(F.col("__v"))).drop("__d", "__v")


def single_parcel(documents: DataFrame, parcels: DataFrame, doc: str = "document_id", parcel: str = "bbl") -> DataFrame:
    """Documents of exactly one distinct parcel, with that parcel."""
    one = parcels.groupBy(doc).agg(F.count_distinct(parcel).alias("n"), F.min(parcel).alias(parcel)).where("n = 1").drop("n")
    return documents.drop(parcel).join(one, doc)


def mutual_unique(
    sales: DataFrame, filings: DataFrame, low: int, high: int, *, eligible: Column | None = None, sale: str = "sale_id", key: str = "bbl",
    day: str = "sale_date", doc: str = "doc_id", doc_day: str = "doc_date",
) -> DataFrame:
    """1, 0 or -1 per eligible sale: financed, no filing, ambiguous.

    1 needs one filing in [low, high] days of the sale, and for that filing no other sale, eligible or not, in the
    reflected window.
    """
    hits = band(sales.select(sale, key, day), filings.select(key, doc, doc_day), [key], day, doc_day, low, high, "inner")
    claims = hits.groupBy(f"r_{doc}").agg(F.count("*").alias("claims"))
    counted = hits.select(sale, F.col(f"r_{doc}").alias("d")).join(claims.withColumnRenamed(f"r_{doc}", "d"), "d")
    found = counted.groupBy(sale).agg(F.count("*").alias("n"), F.max("claims").alias("claims"), F.min("d").alias("d"))
    own = sales.select(sale) if eligible is None else sales.where(eligible).select(sale)
    n, alone = F.coalesce("n", F.lit(0)), (F.col("n") == 1) & (F.col("claims") == 1)
    label = F.when(n == 0, 0).when(alone, 1).otherwise(-1)
    return own.join(found, sale, "left").select(
        sale, n.cast("long").alias("candidates"), F.when(n == 1, F.col("claims")).alias("competing"),
        F.when(n == 1, F.col("d")).alias(doc), label.cast("int").alias("label"),
    )


def count_rule(
    sales: DataFrame, filings: DataFrame, *, eligible: Column | None = None, sale: str = "sale_id", key: str = "bbl", day: str = "sale_date",
    doc_day: str = "doc_date", around: int = 45, low: int = -60, high: int = 135, spread: bool = False,
) -> DataFrame:
    """m filings against k sales: 0 if m = 0, 1 if m >= k, else -1; by eligible sales (k) and by all (all_k).

    ``spread`` deals a hot key's sales over tasks, see ``pairing.rolling_count``.
    """
    ok = F.lit(True) if eligible is None else eligible
    counted = rolling_count(sales.withColumn("__ok", ok), key, day, around, "all_k", spread=spread)
    counted = rolling_count(counted, key, day, around, "k", F.col("__ok"), spread=spread).where("__ok").select(sale, key, day, "k", "all_k")
    hits = band(counted, filings.select(key, doc_day), [key], day, doc_day, low, high)
    m = hits.groupBy(sale, "k", "all_k").agg(F.count("gap").alias("m"))
    label = lambda k: F.when(F.col("m") == 0, 0).when(F.col("m") >= F.col(k), 1).otherwise(-1)
    return m.select(sale, "k", "all_k", "m", label("k").alias("legacy"), label("all_k").alias("all_competitors"))


def first_hit(
    sales: DataFrame, filings: DataFrame, low: int, high: int, *, sale: str = "sale_id", key: str = "bbl", day: str = "sale_date",
    doc: str = "doc_id", doc_day: str = "doc_date",
) -> DataFrame:
    """The earliest filing near each sale that has one; ties go to the smaller document."""
    hits = band(sales.select(sale, key, day), filings.select(key, doc, doc_day), [key], day, doc_day, low, high, "inner")
    first = hits.groupBy(sale).agg(F.min(F.struct(F.col(f"r_{doc_day}").alias("d"), F.col(f"r_{doc}").alias("i"))).alias("f"))
    return first.select(sale, F.col("f.i").alias(doc), F.col("f.d").alias(doc_day))


def lookup(left: DataFrame, dimension: DataFrame, key: str, defaults: dict) -> DataFrame:
    """Left rows with the dimension's columns, or defaults where the key is unknown."""
    out = left.join(small(dimension), key, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def join_one(left: DataFrame, right: DataFrame, keys: list[str], *, both: bool = False) -> DataFrame:
    """A left join that must not multiply rows: raises if keys repeat on the right (or, with ``both``, on the left)."""
    for side in (right, left) if both else (right,):
        if not side.groupBy(*keys).count().where("count > 1").isEmpty():
            raise ValueError(f"keys {keys} are not unique")
    return left.join(right, keys, "left")


def endpoint_flags(pairs: DataFrame, flags: DataFrame, doc: str, names: list[str], sides: tuple[str, ...] = ("a", "z")) -> DataFrame:
    """A document's flags on both ends of each pair, false where the document is unknown."""
    for s in sides:
        own = flags.select(F.col(doc).alias(f"{doc}_{s}"), *[F.col(n).alias(f"{n}_{s}") for n in names])
        pairs = pairs.join(own, f"{doc}_{s}", "left").withColumns({f"{n}_{s}": F.coalesce(f"{n}_{s}", F.lit(False)) for n in names})
    return pairs


def locate(pairs: DataFrame, cases: DataFrame, keys: list[str]) -> DataFrame:
    """Cases with how many pairs their keys name (each should name one)."""
    n = pairs.groupBy(*keys).agg(F.count("*").alias("rows"))
    return cases.join(n, keys, "left").withColumn("rows", F.coalesce("rows", F.lit(0)))


def shared_ends(pairs: DataFrame, parcel: str, a: str, z: str, name: str = "sharing") -> DataFrame:
    """Pairs with how many pairs, themselves included, have their parcel or one of their two end nodes.

    Counted by inclusion and exclusion, so no pair of pairs is formed: a node's pairs, less those with both nodes, plus
    the parcel's, less the parcel's own count of the former. Counts are over cells of parcel and two nodes; a parcel
    has as many cells as the calendar has edges at most. A null parcel is shared with nobody.
    """
    lo, hi = F.least(a, z), F.greatest(a, z)
    rows = pairs.withColumns({"__lo": lo, "__hi": hi})
    cells = rows.groupBy(F.col(parcel).alias("__parcel"), "__lo", "__hi").agg(F.count("*").alias("__c"))
    edges = cells.groupBy("__lo", "__hi").agg(F.sum("__c").alias("__edge"))
    both = F.explode(F.array_distinct(F.array("__lo", "__hi"))).alias("__node")
    nodes = edges.select("__edge", both).groupBy("__node").agg(F.sum("__edge").alias("__n"))
    twice = F.col("__lo") != F.col("__hi")  # both nodes are counted, pairs with both of them once too often
    over = edges.select("__lo", "__hi", "__edge", both).join(F.broadcast(nodes), "__node")  # the calendar: small by nature
    over = over.groupBy("__lo", "__hi", "__edge").agg(F.sum("__n").alias("__t"))
    over = over.select("__lo", "__hi", (F.col("__t") - F.when(twice, F.col("__edge")).otherwise(0)).alias("__t"))
    own = F.sum("__c").over(Window.partitionBy("__parcel"))
    at = F.sum("__c").over(Window.partitionBy("__parcel", "__node"))
    within = cells.withColumn("__own", own).select("*", both).withColumn("__at", at)
    within = within.groupBy("__parcel", "__lo", "__hi", "__c", "__own").agg(F.sum("__at").alias("__at"))
    extra = F.col("__own") - F.col("__at") + F.when(twice, F.col("__c")).otherwise(0)
    extra = F.when(F.col("__parcel").isNotNull(), extra).otherwise(0)
    within = within.join(F.broadcast(over), ["__lo", "__hi"]).select(
        "__parcel", F.col("__lo").alias("__l"), F.col("__hi").alias("__h"), (F.col("__t") + extra).alias(name)
    )
    same = F.col(parcel).eqNullSafe(F.col("__parcel")) & (F.col("__lo") == F.col("__l")) & (F.col("__hi") == F.col("__h"))
    return rows.join(within, same).drop("__lo", "__hi", "__l", "__h", "__parcel")


def reconcile(queue: DataFrame, readings: DataFrame, keys: list[str], immutable: list[str]) -> DataFrame:
    """Keys that only one side has, and keys whose immutable fields differ."""
    r = _prefixed(readings, "r_")
    same = [F.col(k) == F.col(f"r_{k}") for k in keys]
    both = queue.join(r, same, "full_outer")
    changed = F.lit(False)
    for c in immutable:
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"r_{c}"))
    lone = lambda c: F.col(c).isNull()
    problem = F.when(lone(f"r_{keys[0]}"), "missing").when(lone(keys[0]), "unknown").when(changed, "changed")
    return both.select(*[F.coalesce(F.col(k), F.col(f"r_{k}")).alias(k) for k in keys], problem.alias("problem")).where("problem is not null")


def override(rows: DataFrame, edits: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Rows with the fields replaced by the edits (keys, field, value) that name them."""
    wide = edits.groupBy(*keys).pivot("field", fields).agg(F.max("value"))
    wide = wide.withColumnsRenamed({f: f"__{f}" for f in fields})
    out = rows.join(wide, keys, "left")
    return out.withColumns({f: F.coalesce(f"__{f}", f) for f in fields}).drop(*[f"__{f}" for f in fields])
