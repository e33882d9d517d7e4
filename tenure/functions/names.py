"""Party names and addresses: surnames, companies and trusts, lenders, street keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Word lists that decide what a name is.
COMPANY = (
    r"(?i)\b(LLC|L\.?L\.?C|INC|CORP|CORPORATION|COMPANY|LP|L\.?P|LLP|LTD|REALTY|PROPERTIES|HOLDINGS?|ASSOCIATES|PARTNERS\w*|VENTURES?"
    r"|CAPITAL|EQUITIES|GROUP|ENTERPRISES?|DEVELOPMENT|BUILDERS?|CONSTRUCTION|MANAGEMENT|INVESTMENTS?|FUND|BANK|HOUSING|AUTHORITY)\b"
)
TRUST = r"(?i)\b(TRUST|TRUSTEE|ESTATE|EXECUTOR|EXECUTRIX|ADMINISTRATOR)\b"
LENDER_BROAD = (
    r"(?i)\b(BANK|MORTGAGE|SERVICING|LOAN|FEDERAL NATIONAL|FANNIE MAE|FREDDIE MAC|SECRETARY OF HOUSING|CERTIFICATEHOLDERS|MERS|SAVINGS"
    r"|NATIONAL ASSOCIATION)\b"
)
LENDER_HIGH = (
    r"(?i)\b(WELLS FARGO|JPMORGAN|JP MORGAN|J P MORGAN|BANK OF AMERICA|DEUTSCHE BANK|U\.?\s*S\.?\s*BANK|US BANK|CITIBANK|CITIMORTGAGE"
    r"|HSBC BANK|BANK OF NEW YORK|FEDERAL NATIONAL MORTGAGE|FEDERAL HOME LOAN MORTGAGE|FANNIE MAE|FREDDIE MAC|SECRETARY OF HOUSING|HUD"
    r"|OCWEN|NATIONSTAR|DITECH|BAC HOME LOANS|BANK OF AMER|PNC BANK|ONEWEST BANK|INDYMAC|WASHINGTON MUTUAL|EMIGRANT"
    r"|GREEN TREE SERVICING|NEW YORK COMMUNITY BANK)\b"
)
NOT_PERSON = (
    r"\b(LLC|L\.L\.C|INC|CORP|CORPORATION|COMPANY|CO\.|BANK|TRUST|TRUSTEE|TRUSTEES|ESTATE|EXECUTOR|EXECUTRIX|ADMINISTRATOR|ASSOCIATION"
    r"|FUND|PARTNERS|LP|L\.P|HOLDINGS|REALTY|GROUP|MORTGAGE|FEDERAL|SECRETARY|CITY OF|MANAGEMENT|PROPERTIES|DEVELOPMENT|CAPITAL|ASSOC"
    r"|N\.A|FSB|SERVICING|REFEREE)\b"
)
NOT_STREET = r"\b(?:P\.?O\.?\s*BOX|C/O|CARE OF|ATTN)\b"
UNIT_SUFFIX = r"\b(?:APT|APARTMENT|UNIT|SUITE|STE|FL|FLOOR|#)\b.*$"
STREET_SUFFIX = {
    "STREET": "ST", "AVENUE": "AVE", "ROAD": "RD", "BOULEVARD": "BLVD", "DRIVE": "DR", "PLACE": "PL", "LANE": "LN", "COURT": "CT",
    "TERRACE": "TER", "PARKWAY": "PKWY",
}


def is_company(name: Column) -> Column:
    return F.coalesce(name.rlike(COMPANY), F.lit(False))


def is_trust(name: Column) -> Column:
    return F.coalesce(name.rlike(TRUST), F.lit(False))


def lender_high(name: Column) -> Column:
    return F.coalesce(name.rlike(LENDER_HIGH), F.lit(False))


def lender_broad(name: Column) -> Column:
    return F.coalesce(name.rlike(LENDER_BROAD), F.lit(False))


def surname(name: Column) -> Column:
    """What precedes the first comma of a person's name, if it has two letters at least."""
    clean = F.upper(F.trim(name))
    part = F.trim(F.split_part(clean, F.lit(","), F.lit(1)))
    return F.when(~clean.rlike(NOT_PERSON) & clean.contains(",") & (F.length(part) > 1), part)


def party_category(names: Column) -> Column:
    """entity, trust, unknown or person of an array of one side's names: a company anywhere comes before a trust."""
    known = F.filter(names, lambda n: n != "")
    return (
        F.when(F.coalesce(F.size(known), F.lit(0)) <= 0, "unknown")
        .when(F.exists(known, lambda n: n.rlike(COMPANY)), "entity")
        .when(F.exists(known, lambda n: n.rlike(TRUST)), "trust")
        .otherwise("person")
    )


def street_key(address: Column, city: Column, postal: Column) -> Column:
    """(street, city, zip) of a street address that begins with a number; null for boxes, care-of and incomplete ones."""
    raw = F.upper(F.trim(address))
    tokens = F.regexp_extract_all(F.regexp_replace(raw, UNIT_SUFFIX, ""), F.lit("[A-Z0-9]+"), F.lit(0))
    suffix = F.create_map(*[F.lit(x) for pair in STREET_SUFFIX.items() for x in pair])
    street = F.array_join(F.transform(tokens, lambda t: F.coalesce(F.try_element_at(suffix, t), t)), " ")
    town = F.array_join(F.regexp_extract_all(F.upper(city), F.lit("[A-Z0-9]+"), F.lit(0)), " ")
    code = F.substring(F.regexp_replace(postal, r"\D", ""), 1, 5)
    usable = (raw != "") & ~raw.rlike(NOT_STREET) & (F.size(tokens) >= 2) & F.get(tokens, 0).rlike(r"\d")
    usable = usable & (town != "") & (F.length(code) == 5)
    return F.when(usable, F.struct(street.alias("street"), town.alias("city"), code.alias("zip")))
