"""Fields of a recorded document's cover page out of its recognised text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the transfer tax as a share of the consideration.
TRANSFER_TAX = 0.004


def money_after(text: Column, label: str) -> Column:
    """The first dollar amount behind a label; null without one."""
    found = F.regexp_extract(text, rf"(?is){label}.*?\$?\s*([0-9][0-9,]*\.[0-9]{{2}})", 1)
    return F.regexp_replace(found, ",", "").try_cast("double")


def parse_cover(text: Column) -> Column:
    """Taxes, the consideration that the transfer tax implies, and whether grantor and grantee give one address."""
    city, state = money_after(text, "NYC REAL PROPERTY TRANSFER TAX"), money_after(text, "NYS REAL ESTATE TRANSFER TAX")
    clean = lambda c: F.regexp_replace(F.upper(c), r"[^A-Z0-9]+", " ")
    address = lambda role: F.trim(clean(F.regexp_extract(text, rf"(?im)^{role} ADDRESS:\s*(.+)$", 1)))
    grantor, grantee = address("GRANTOR"), address("GRANTEE")
    return F.struct(
        city.alias("city_tax"), state.alias("state_tax"), (state / F.lit(TRANSFER_TAX)).alias("consideration"),
        ((grantor != "") & (grantor == grantee)).alias("same_address"),
    )
