"""Fixed schemas of the source tables. Identifiers are text; nothing is inferred."""

from __future__ import annotations

PANEL = "bbl string, date date, price double, borough string, src string, financed_strict int, financed_base int, financed_wide int, mort_amt double, n_sale int, n_sales_total int"
PERMITS = "job__ string, borough string, block string, lot string, job_type string, issuance_date string"
MASTER = "document_id string, doc_type string, document_date string, document_amt string, recorded_datetime string"
LEGALS = "document_id string, borough string, block string, lot string, property_type string"
PARTIES = "document_id string, party_type string, name string"
PARTY_ADDRESSES = f"{PARTIES}, address_1 string, address_2 string, city string, zip string"
GEO = "bbl string, zipcode string, cd string, bct2020 string, version string"
COOP_SALES = "sale_price string, sale_date string, borough string, bbl string, building_class_category string, apartment_number string, address string"
DENIALS = "year int, area string, action int, count long"
DEED_MAP = "map<string, array<array<string>>>"
