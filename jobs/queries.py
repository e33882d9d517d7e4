"""The jobs as queries: each runs its job twice into one fresh folder and returns the output after the second run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from jobs import evidence_register, repeat_sale_panel
from tenure.functions import names
from tenure.operators.tables import scratch
from tenure.plans.registry import rounded, with_views


def job1_repeat_sale_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch(spark, "job1")
    for _ in range(2):
        result = repeat_sale_panel.run(spark, sf_dir, out, repeat_sale_panel.settings())
    return rounded(result)


def job2_evidence_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, documents = scratch(spark, "job2"), f"{sf_dir}/documents.parque[t]"  # a pattern, as a table may be one file
    for _ in range(2):
        result = evidence_register.run(spark, documents, f"{base}/out", f"{base}/checkpoint", evidence_register.settings())
    return rounded(result)


QUERIES = {"job1_repeat_sale_panel": job1_repeat_sale_panel, "job2_evidence_register": job2_evidence_register}

_AS_OF = "(select round(max_by(rate, observed), 6) from rates where observed <= e.date_{0}) as rate_{0}"
PANEL_SQL = f"""select bbl, zipcode, src, sale_id_a, sale_id_z, date_a, date_z, price_a, price_z, financed_strict_a, financed_strict_z, financed_base_a,
    financed_base_z, financed_wide_a, financed_wide_z, round(y, 6) as growth, arm, round(datediff('day', date_a, date_z) / 365.25, 6) as years, {_AS_OF.format("a")}, {_AS_OF.format("z")},
    exists (select 1 from permits q where q.bbl = e.bbl and issued between date_a and date_z) as permit, borough, cast(year(date_z) as integer) as year
    from enriched e"""


def _named(pattern: str) -> str:
    return f"coalesce(regexp_matches(text, '{pattern}'), false)"


REGISTER_SQL = rf"""with d as (select doc_id, source, case when regexp_matches(coalesce(text, ''), '[^\x09-\x0D\x20]') then sha256(text) end as text_sha256,
    cast(coalesce(strlen(text), 0) as bigint) as n_bytes, {_named(names.LENDER_HIGH)} as lender_high, {_named(names.LENDER_BROAD)} as lender_broad,
    {_named(names.COMPANY)} as company, {_named(names.TRUST)} as trust,
    round(try_cast(replace(regexp_extract(text, '(?is)NYS REAL ESTATE TRANSFER TAX.*?\$?\s*([0-9][0-9,]*\.[0-9]{{2}})', 1), ',', '') as double) / 0.004, 6) as consideration
    from documents),
f as (select *, case when text_sha256 is not null then min(doc_id) over (partition by text_sha256) end as first_id from d)
select doc_id, source, text_sha256, n_bytes, lender_high, lender_broad, company, trust, consideration, first_id, 0 as batch,
    case when text_sha256 is null then 'empty' when first_id <> doc_id or (doc_id is null and first_id is not null) then 'copy'
    when consideration is not null then 'cover' when lender_high or lender_broad then 'lender' when company or trust then 'party' else 'other' end as queue
from f"""

ORACLE_SQL = {"job1_repeat_sale_panel": with_views(PANEL_SQL), "job2_evidence_register": REGISTER_SQL}
