"""Scans in an order within keys, in two levels, so that a key with a third of all rows takes many tasks.

Rows are range-sorted by key and order into a table of parts. Each part is scanned on its own; a key that goes on in the
next part hands over a carry: how many rows it had, its last item, its last value that isn't null. Only a part's first and
last key can go on, so there are two carries a part at most, whatever the number of keys or rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import written


def scanned(
    rows: DataFrame, keys: list[str], order: list[str | Column], *, number: str | None = None, total: str | None = None,
    previous: dict[str, str] | None = None, latest: dict[str, str] | None = None, parts: int | None = None,
) -> DataFrame:
    """Rows with what a scan of their key in ``order`` tells them.

    ``number`` is the row's number from 1 and ``total`` the key's number of rows; ``previous`` names columns for the value
    that another column had in the row before, ``latest`` for its last value up to and with the row that isn't null.
    Without keys the whole table is one scan. Null keys are a key of their own, nulls in the order come first, and rows
    that are equal in key and order come in any order, side by side (``previous`` may tell any of theirs). An empty table gives an empty result.
    """
    previous, latest = previous or {}, latest or {}
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    own = {f"__o{i}": o for i, o in enumerate(order)}
    sort = [*keys, *own]
    rows = rows.withColumns(own)
    # rows that tie may be parted as well: their hash is a last sort key of the parts, not of the scan
    tie = F.xxhash64(*[c for c, t in rows.dtypes if "map<" not in t])
    ranged = rows.repartitionByRange(*([parts] if parts else []), *sort, tie)
    table = written(ranged.withColumn("__part", F.spark_partition_id()), "scan")

    where = ["__part", *keys]
    scan = Window.partitionBy(*where).orderBy(*own)
    so_far = scan.rowsBetween(Window.unboundedPreceding, 0)
    inner = {"__number": F.row_number().over(scan).cast("long")} if number else {}
    inner |= {"__total": F.count("*").over(Window.partitionBy(*where))} if total else {}
    # a struct tells a row before that had null from no row before
    inner |= {f"__p_{n}": F.lag(F.struct(F.col(c).alias("v"))).over(scan) for n, c in previous.items()}
    inner |= {f"__l_{n}": F.last(c, ignorenulls=True).over(so_far) for n, c in latest.items()}
    out = table.withColumns(inner).join(F.broadcast(_carries(table, keys, own, previous, latest)), _same(where), "left")

    told = {}
    if number:
        told[number] = F.col("__number") + F.coalesce("__c_before", F.lit(0))
    if total:
        told[total] = F.coalesce("__c_all", "__total")
    told |= {n: F.coalesce(f"__p_{n}", f"__c_p_{n}")["v"] for n in previous}
    told |= {n: F.coalesce(f"__l_{n}", f"__c_l_{n}") for n in latest}
    kept = [c for c in rows.columns if c not in own and c not in told]
    return out.select(*kept, *[c.alias(n) for n, c in told.items()])


def _same(columns: list[str]) -> Column:
    on = F.col(columns[0]) == F.col(f"__c_{columns[0]}")
    for c in columns[1:]:
        on &= F.col(c).eqNullSafe(F.col(f"__c_{c}"))
    return on


def _carries(table: DataFrame, keys: list[str], own, previous: dict[str, str], latest: dict[str, str]) -> DataFrame:
    """What each part's first and last key had in the parts before: two rows a part at most."""
    key = F.struct(F.lit(0).alias("__k"), *keys)
    ends = table.groupBy("__part").agg(F.array_distinct(F.array(F.min(key), F.max(key))).alias("ends"))
    ends = ends.select(F.col("__part").alias("__c___part"), F.inline("ends"))
    ends = ends.select("__c___part", *[F.col(k).alias(f"__c_{k}") for k in keys])
    held = table.join(F.broadcast(ends), _same(["__part", *keys]), "left_semi")
    place = F.struct(*own)
    sums = [F.count("*").alias("__n")]
    sums += [F.max_by(F.struct(F.col(c).alias("v")), place).alias(f"__p_{n}") for n, c in previous.items()]
    sums += [F.max_by(c, F.when(F.col(c).isNotNull(), place)).alias(f"__l_{n}") for n, c in latest.items()]
    ends = held.groupBy("__part", *keys).agg(*sums)
    every = Window.partitionBy(*keys)  # a row a part
    before = every.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.sum("__n").over(before).alias("__c_before"), F.sum("__n").over(every).alias("__c_all")]
    carried += [F.last(f"__p_{n}").over(before).alias(f"__c_p_{n}") for n in previous]
    carried += [F.last(f"__l_{n}", ignorenulls=True).over(before).alias(f"__c_l_{n}") for n in latest]
    return ends.select(F.col("__part").alias("__c___part"), *[F.col(k).alias(f"__c_{k}") for k in keys], *carried)
