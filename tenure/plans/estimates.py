"""Estimates against SQL that solves the normal equations itself: elimination, a column a step of a recursive query.

The SQL builds the design from the definition (long rows of name and value), sums its products and takes one column after
another out of the others, calendar first; what stands in the targets' rows at the end are their coefficients. It shares
nothing with the library but the definition of the pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenure.functions.measures import switched, trend_years
from tenure.operators import estimation, linkage, passes

from .equations import QUARTER, TARGETS, _rows, _without
from .registry import ORACLE_SQL, query


def coefficients_sql(targets: dict[str, str], *, rows: str = "enriched", weight: str = "1") -> str:
    """(target, coefficient) of least squares on the targets and a calendar by borough."""
    place = "concat('q:', borough, ':', cast(" + QUARTER.replace("(d)", "({0})") + " as varchar))"
    ends = [(place.format("date_a"), "-1"), (place.format("date_z"), "1"), *[(f"'t:{k}'", v) for k, v in targets.items()], ("'y'", "y")]
    entries = " union all ".join(f"select r, w, {k} as k, cast({v} as double) as v from b" for k, v in ends)
    return f"""with b as materialized (select row_number() over () as r, {weight} as w, * from {rows}),
    x as materialized (select r, k, max(w) as w, sum(v) as v from ({entries}) where k not like 'q:%:0' group by 1, 2),
    n as materialized (select k, row_number() over (order by case when k = 'y' then 2 when k like 't:%' then 1 else 0 end, k) as p from (select distinct k from x)),
    g as (select a.k as i, c.k as j, sum(a.w * a.v * c.v) as v from x a join x c on c.r = a.r group by 1, 2),
    f as materialized (select ni.p as i, nj.p as j, coalesce(v, 0) as v from n ni cross join n nj left join g on g.i = ni.k and g.j = nj.k where ni.k <> 'y'),
    step(s, i, j, v) as (
        select cast(0 as bigint), i, j, v from f
        union all
        select c.s + 1, c.i, c.j, case when abs(p.v) < 1e-6 then c.v when c.i = p.i then c.v / p.v else c.v - own.v * below.v / p.v end
        from step c join step p on p.i = c.s + 1 and p.j = p.i join step own on own.i = c.i and own.j = p.i join step below on below.i = p.i and below.j = c.j
        where c.j > p.i and (c.i > p.i or c.i in (select p from n where k like 't:%'))
    )
    select substr(k, 3) as target, round(v, 6) as coefficient from step join n on n.p = step.i where s = (select max(s) from step) and k like 't:%'"""


def solved(name: str, targets: dict[str, str], **design: str):
    """Register a query of coefficients with the SQL that eliminates."""

    def register(f):
        query(name, coefficients_sql(targets, **design))(f)
        ORACLE_SQL[name] = "with recursive " + ORACLE_SQL[name].removeprefix("with ")
        return f

    return register


def _named(t, values: dict[str, float]) -> DataFrame:
    return t.spark.createDataFrame([(k, round(float(v), 6) + 0.0) for k, v in values.items()], "target string, coefficient double")


def _fitted(t, rows: DataFrame, targets: list[str]) -> DataFrame:
    named = passes.least_squares(rows, targets)[1]
    return _named(t, {k: named[f"t:{k}"] for k in targets})


ARMS = {"cf": "cf", "fc": "fc"}


@solved("m04_coefficients", ARMS)
def m04(t):
    """The joint contrast's two arms."""
    result, _ = estimation.contrast(t.enriched, "borough", "bbl")
    return _named(t, dict(zip(TARGETS, result["beta"], strict=True)))


@solved("m04_coefficients_apart", ARMS)
def m04_apart(t):
    """The same with each area's columns taken out in a task of its own."""
    result, _ = estimation.contrast(t.enriched, "borough", "bbl", apart=True)
    return _named(t, dict(zip(TARGETS, result["beta"], strict=True)))


RATED = """(select e.*, coalesce(ra.rate, 19.0) - 19 as over_a, coalesce(rz.rate, 19.0) - 19 as over_z from enriched e
    asof left join rates ra on e.date_a >= ra.observed asof left join rates rz on e.date_z >= rz.observed)"""


@solved("m09_coefficients", ARMS | {"slope_a": "financed_base_a * over_a", "slope_z": "financed_base_z * over_z"}, rows=RATED)
def m09(t):
    """Financing at either end by the rate of its week above 19."""
    rated = linkage.as_of(t.enriched, t.rates, "date_a", "observed", "rate").withColumnRenamed("rate", "rate_a")
    rated = linkage.as_of(rated, t.rates, "date_z", "observed", "rate").withColumnRenamed("rate", "rate_z")
    extra = {f"slope_{s}": F.col(f"financed_base_{s}") * (F.coalesce(f"rate_{s}", F.lit(19.0)) - 19) for s in "az"}
    return _fitted(t, _rows(t, rated, extra=extra), [*TARGETS, *extra])


@solved("m11_coefficients", ARMS, weight="1 + sale_id_z % 3")
def m11(t):
    return _fitted(t, _rows(t, weight=1 + F.col("sale_id_z") % 3), TARGETS)


OWN = "cast(src = 'BUILDING' as integer)"


@solved("m16_coefficients", {"cf1": f"cf * {OWN}", "fc1": f"fc * {OWN}", "cf0": f"cf * (1 - {OWN})", "fc0": f"fc * (1 - {OWN})"})
def m16(t):
    own = (F.col("src") == "BUILDING").cast("double")
    four = {"cf1": F.col("cf") * own, "fc1": F.col("fc") * own, "cf0": F.col("cf") * (1 - own), "fc0": F.col("fc") * (1 - own)}
    return _fitted(t, _without(_rows(t, extra=four), "t:cf", "t:fc"), list(four))


TREND = "financed_base_{0} * datediff('day', date '1998-01-01', date_{0}) / cast(365.25 as double)"


@solved("m20_coefficients", ARMS | {f"slope_{s}": TREND.format(s) for s in "az"})
def m20(t):
    extra = {f"slope_{s}": F.col(f"financed_base_{s}") * trend_years(F.col(f"date_{s}"), "1998-01-01") for s in "az"}
    return _fitted(t, _rows(t, extra=extra), [*TARGETS, *extra])


def _window(w: str) -> str:
    a, z = f"financed_{w}_a", f"financed_{w}_z"
    return f"(select * replace (cast({a} = 0 and {z} = 1 as integer) as cf, cast({a} = 1 and {z} = 0 as integer) as fc) from enriched)"


def _by_window(w: str):
    @solved(f"m35_coefficients_{w}", ARMS, rows=_window(w))
    def m35(t):
        """The contrast under another financing window, pairs and calendar held fixed."""
        cf, fc = switched(F.col(f"financed_{w}_a"), F.col(f"financed_{w}_z"))
        return _fitted(t, _rows(t, t.enriched.withColumns({"cf": cf, "fc": fc})), TARGETS)


for _w in ("strict", "wide"):
    _by_window(_w)
