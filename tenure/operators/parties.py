"""Names of a document's sides: sets by role, related parties, addresses in common."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenure.functions import names as n

from .summary import common_names

SELLER, BUYER = "1", "2"


def names_by_role(parties: DataFrame, doc: str = "document_id", role: str = "party_type", name: str = "name") -> DataFrame:
    """The set of upper-case, trimmed, non-empty names per document and role."""
    clean = F.nullif(F.upper(F.trim(name)), F.lit(""))
    return parties.groupBy(doc, role).agg(F.collect_set(clean).alias("names"))


def surname_sets(parties: DataFrame, doc: str = "document_id", role: str = "party_type", name: str = "name") -> DataFrame:
    """Per document the sets of sellers' and buyers' surnames; other roles are left out."""
    s = n.surname(F.col(name))
    side = lambda r: F.collect_set(F.when(F.col(role) == r, s))
    return parties.where(F.col(role).isin(SELLER, BUYER)).groupBy(doc).agg(side(SELLER).alias("sellers"), side(BUYER).alias("buyers"))


def related(parties: DataFrame, doc: str = "document_id", role: str = "party_type", name: str = "name", common: int = 40) -> DataFrame:
    """Documents whose sides share a surname; ``strict`` does not count the ``common`` most frequent surnames."""
    named = parties.where(F.col(role).isin(SELLER, BUYER)).withColumn("surname", n.surname(F.col(name)))
    frequent = common_names(named, [doc, role], "surname", common).agg(F.collect_set("surname").alias("frequent"))
    sets = surname_sets(parties, doc, role, name).crossJoin(F.broadcast(frequent))  # one row of at most ``common`` names
    both = F.array_intersect("sellers", "buyers")
    return sets.select(doc, (F.size(both) > 0).alias("related"), (F.size(F.array_except(both, "frequent")) > 0).alias("related_strict"))


def shared_address(rows: DataFrame, doc: str = "document_id", role: str = "party_type") -> DataFrame:
    """Documents whose sides give one street address."""
    key = n.street_key(F.col("address_1"), F.col("city"), F.col("zip"))
    side = lambda r: F.collect_set(F.when(F.col(role) == r, key))
    sets = rows.groupBy(doc).agg(side(SELLER).alias("s"), side(BUYER).alias("b"))
    return sets.select(doc, (F.size(F.array_intersect("s", "b")) > 0).alias("shared_address"))


def lender_audit(parties: DataFrame, name: str = "name", role: str = "party_type") -> DataFrame:
    """Counts of names that a lender list hits, by name, role and list, most frequent first."""
    high, broad = n.lender_high(F.col(name)), n.lender_broad(F.col(name))
    rows = parties.select(name, role, high.alias("high"), broad.alias("broad")).where("high or broad")
    return rows.groupBy(name, role, "high", "broad").agg(F.count("*").alias("n")).orderBy(F.desc("n"), name, role)


def category_indicators(parties: DataFrame, doc: str = "document_id", role: str = "party_type") -> DataFrame:
    """Per document 0/1 indicators buyer_entity, buyer_trust, buyer_unknown and the same for sellers."""
    by = names_by_role(parties, doc, role).withColumn("category", n.party_category(F.col("names")))
    out = []
    for side, code in (("buyer", BUYER), ("seller", SELLER)):
        of = lambda c, code=code: F.max(F.when((F.col(role) == code) & (F.col("category") == c), 1))
        seen = F.max(F.when((F.col(role) == code) & (F.col("category") != "unknown"), 1))
        out += [F.coalesce(of(c), F.lit(0)).alias(f"{side}_{c}") for c in ("entity", "trust")]
        out.append(F.when(seen.isNull(), 1).otherwise(0).alias(f"{side}_unknown"))
    return by.groupBy(doc).agg(*out)
