"""Dates, prices and labels of sales and pairs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAYS_A_YEAR = 365.25


def quarter_index(day: Column, base_year: int = 2016) -> Column:
    """Quarters since the first of ``base_year``, which is 0."""
    return (F.year(day) - base_year) * 4 + F.quarter(day) - 1


def log_growth(first: Column, second: Column) -> Column:
    return F.log(second / first)


def holding_years(first: Column, second: Column) -> Column:
    return F.datediff(second, first) / F.lit(DAYS_A_YEAR)


def annual_growth(growth: Column, years: Column) -> Column:
    return F.try_divide(growth, years)


def trend_years(day: Column, origin: str = "2020-01-01") -> Column:
    return F.datediff(day, F.lit(origin).cast("date")) / F.lit(DAYS_A_YEAR)


def previous_month(day: Column) -> Column:
    """First day of the month before."""
    return F.add_months(F.trunc(day, "MM"), -1)


def property_type(building_class: Column, types: dict[str, tuple[str, ...]], default: str | None = None) -> Column:
    """The type whose two-character class prefixes hold the code."""
    code, out = F.substring(F.trim(building_class), 1, 2), F.lit(default)
    for name, codes in reversed(types.items()):
        out = F.when(code.isin(*codes), F.lit(name)).otherwise(out)
    return out


def period(day: Column, transition: str, post: str) -> Column:
    """pre, transition or post, by the two days on which the latter begin."""
    start, end = F.lit(transition).cast("date"), F.lit(post).cast("date")
    return F.when(day < start, "pre").when(day < end, "transition").otherwise("post")


def arm(financed_a: Column, financed_z: Column) -> Column:
    """cc, cf, fc or ff: cash or financed at the first and the second sale."""
    letter = lambda c: F.when(c == 1, "f").otherwise("c")
    return F.concat(letter(financed_a), letter(financed_z))


def switched(financed_a: Column, financed_z: Column) -> tuple[Column, Column]:
    """Dummies of the arms cash to financed and financed to cash."""
    cf, fc = (financed_a == 0) & (financed_z == 1), (financed_a == 1) & (financed_z == 0)
    return cf.cast("int"), fc.cast("int")


#: Fixed values of the mortgage recording tax: rates below and from the step.
TAX_STEP, TAX_BELOW, TAX_FROM = 500_000, 0.018, 0.01925


def tax_burden(loan: Column, price: Column) -> Column:
    """Recording tax as a share of the price, for a loan-to-value in (0.05, 1.05]; else null."""
    ratio = F.try_divide(loan, price)
    rate = F.when(loan < TAX_STEP, F.lit(TAX_BELOW)).otherwise(F.lit(TAX_FROM))
    return F.when((ratio > 0.05) & (ratio <= 1.05), rate * ratio)


def invert_discount(contrast: Column, q: Column) -> Column:
    """The discount that a contrast implies if a share q of sellers faces it."""
    return F.expm1(contrast) * (1 - q) / q


def denial_rate(originated: Column, denied: Column) -> Column:
    return F.try_divide(denied, originated + denied)


def verdict(low: Column, high: Column, threshold: Column | float) -> Column:
    """Where an interval lies: above, below, or spanning the threshold."""
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return F.when(low > limit, "above").when(high < limit, "below").otherwise("spans")


def amount_matches(amount: Column, price: Column, share: float = 0.01, least: float | None = 1.0) -> Column:
    """A positive amount within ``share`` of the price (``least`` dollars at least, if given)."""
    room = price * share if least is None else F.greatest(F.lit(least), price * share)
    return F.coalesce((amount > 0) & (F.abs(amount - price) <= room), F.lit(False))


def round_dummies(middle: Column, width: float, multiples: tuple[int, ...] = (100_000, 50_000, 25_000)) -> list[Column]:
    """Whether the bin's middle, rounded to the bin width (half to even), is a multiple of each."""
    near = F.bround(middle / F.lit(float(width)), 0) * F.lit(float(width))
    return [(F.pmod(near, F.lit(float(m))) == 0).cast("int") for m in multiples]


def exclusive_round_dummies(low: Column, high: Column, exact: str = "above") -> list[Column]:
    """Whether a bin holds a multiple of 100k; of 50k but not 100k; of 25k but not 50k.

    With ``exact="below"`` a bin is open below and closed above, else the reverse.
    """

    def holds(k: int) -> Column:
        return F.floor(high / k) * k > low if exact == "below" else F.ceil(low / k) * k < high

    a, b, c = holds(100_000), holds(50_000), holds(25_000)
    return [a.cast("int"), (b & ~a).cast("int"), (c & ~b).cast("int")]


def perturbed(outcome: Column, weight: Column, selected: Column, delta: float) -> Column:
    """Selected outcomes moved by ``delta`` against the sign of their weight."""
    return outcome - F.when(selected, F.signum(weight) * delta).otherwise(0.0)


def relabelled(flag: Column, selected: Column, to: int | None = None) -> Column:
    """A 0/1 flag, flipped where selected, or set to ``to``."""
    return F.when(selected, F.lit(to) if to is not None else 1 - flag).otherwise(flag).cast("int")


def wilson(hits: Column, n: Column, z: float = 1.96, clamp: bool = False) -> tuple[Column, Column]:
    """Wilson interval of a share."""
    hits, n = hits.cast(T.DoubleType()), F.nullif(n.cast(T.DoubleType()), F.lit(0.0))
    p, d = hits / n, 1 + z * z / n
    middle, half = (p + z * z / (2 * n)) / d, z / d * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    low, high = middle - half, middle + half
    return (F.greatest(low, F.lit(0.0)), F.least(high, F.lit(1.0))) if clamp else (low, high)
