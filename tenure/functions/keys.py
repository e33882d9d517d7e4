"""Identifiers, dates and other scalars out of loosely typed source text. Bad input gives null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(text: Column) -> Column:
    """Null for null, empty and white-space-only text; else the trimmed text."""
    return F.nullif(F.trim(text), F.lit(""))


def compose_parcel(borough: Column, block: Column, lot: Column) -> Column:
    """The ten-digit parcel key: borough, block in five digits, lot in four; longer parts are not cut."""
    parts = [c.cast("string").try_cast("int") for c in (borough, block, lot)]
    ok = parts[0].isNotNull() & parts[1].isNotNull() & parts[2].isNotNull()
    return F.when(ok, F.format_string("%d%05d%04d", *parts))


def parcel_from_number(text: Column) -> Column:
    """A parcel key that came through a floating-point column, such as ``4162340021.00000000``."""
    return text.cast("string").try_cast("decimal(28,8)").cast("bigint").cast("string")


def day_of(text: Column) -> Column:
    """The date in the first ten characters of an ISO date or timestamp text."""
    return F.substring(text.cast("string"), 1, 10).try_cast("date")


def us_date(text: Column, first_year: int | None = None) -> Column:
    """A ``MM/DD/YYYY`` date; null before ``first_year``."""
    day = F.try_to_date(text, "MM/dd/yyyy")
    return day if first_year is None else F.when(F.year(day) >= first_year, day)


def document_day(document_date: Column, recorded: Column) -> Column:
    """The date of the first of two texts that isn't empty, if that has ten characters at least."""
    chosen = F.coalesce(F.nullif(document_date, F.lit("")), F.nullif(recorded, F.lit("")))
    return F.when(F.length(chosen) >= 10, day_of(chosen))


def unit_key(apartment: Column, address: Column) -> Column:
    """The apartment, else what follows the first comma of the address; upper case, single spaces, '' if there is none."""
    own = blank_to_null(F.upper(apartment))
    after = F.when(F.instr(address, ",") > 0, F.expr("1"))
    tail = F.when(after.isNotNull(), F.regexp_replace(address, r"(?s)^[^,]*,", ""))
    return F.coalesce(F.trim(F.regexp_replace(F.coalesce(own, F.upper(tail)), r"\s+", " ")), F.lit(""))


def zip_clean(text: Column) -> Column:
    """A ZIP code without the ``.0`` of a numeric column."""
    return F.regexp_replace(text, r"\.0$", "")


def zip_valid(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^\d{5}$"), F.lit(False))


def geo_linked(zipcode: Column, district: Column) -> Column:
    """A valid ZIP code and a district."""
    return zip_valid(zipcode) & F.coalesce(district != "", F.lit(False))


def truthy(text: Column) -> Column:
    """True for the texts true and 1 in any case."""
    return F.coalesce(F.lower(text.cast("string")).isin("true", "1"), F.lit(False))


def number_or(text: Column, default: float | None = 0.0) -> Column:
    """A number out of text; ``default`` where it isn't one (None: null, so that a filter skips the row)."""
    value = text.cast("string").try_cast("double")
    return value if default is None else F.coalesce(value, F.lit(default))


def case_id(number: Column, prefix: str = "H", width: int = 3) -> Column:
    return F.format_string(f"{prefix}%0{width}d", number.cast("bigint"))


def document_url(document_id: Column, base: str) -> Column:
    return F.concat(F.lit(base), document_id)
