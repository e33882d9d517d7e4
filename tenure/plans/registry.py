"""Queries over the test tables, each with the SQL that states the same in another engine.

``Tables`` binds the roles of the library (sales, filings, parties, permits, rates, pairs) to the star schema once.
The role views are SQL that Spark and DuckDB both read, so a query's SQL is preceded by the views that it names.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenure.functions import measures
from tenure.operators import linkage, pairing
from tenure.operators.tables import written

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "labels")
HOLD = 180

#: Roles as SQL of both engines; ``{table}`` is a table of the data.
ROLES = {
    "sales": """select o_orderkey as sale_id, cast(o_custkey as string) as bbl, cast(o_orderdate as date) as sale_date,
        cast(o_totalprice as double) as price, cast(c_nationkey as string) as zipcode, cast(n_regionkey as string) as borough, c_mktsegment as src
        from {orders} join {customer} on c_custkey = o_custkey join {nation} on n_nationkey = c_nationkey""",
    "filings": """select concat(cast(l_orderkey as string), '-', cast(l_linenumber as string)) as doc_id, cast(o_custkey as string) as bbl,
        cast(l_shipdate as date) as doc_date, cast(l_extendedprice as double) as amount, l_returnflag as doc_type
        from {lineitem} join {orders} on o_orderkey = l_orderkey""",
    "permits": """select cast(o_custkey as string) as bbl, cast(l_shipdate as date) as issued from {lineitem} join {orders} on o_orderkey = l_orderkey
        where l_returnflag = 'R' and l_linenumber = 1""",
    "rates": """select cast(date_trunc('week', o_orderdate) as date) as observed, round(avg(o_totalprice) / 10000, 6) as rate from {orders} group by 1""",
    "parties": """select cast(o_orderkey as string) as document_id, cast(1 + o_orderkey % 2 as string) as party_type,
        case o_custkey % 6 when 0 then concat('ACME ', cast(o_custkey % 40 as string), ' LLC') when 1 then concat('SMITH', cast(o_custkey % 50 as string), ', JOHN')
        when 2 then 'DOE FAMILY TRUST' when 3 then concat('Jones', cast(o_custkey % 20 as string), ', Ann ') when 4 then 'US BANK NATIONAL ASSOCIATION' else '' end as name
        from {orders} union all select cast(o_orderkey as string), cast(2 - o_orderkey % 2 as string),
        case o_custkey % 5 when 0 then concat('SMITH', cast(o_orderkey % 50 as string), ', MARY') when 1 then 'CITY HOLDINGS CORP' when 2 then 'X, Y'
        when 3 then concat('JONES', cast(o_orderkey % 20 as string), ', BO') else 'LEE, K' end from {orders}""",
}
#: Results of operators that other queries start from, as SQL over the roles.
DERIVED = {
    "flagged": """select s.sale_id, s.bbl, s.sale_date, s.price, s.zipcode, s.borough, s.src,
        cast(coalesce(max(case when datediff('day', s.sale_date, f.doc_date) <= 30 then 1 end), 0) as integer) as financed_strict,
        cast(coalesce(max(case when datediff('day', s.sale_date, f.doc_date) <= 90 then 1 end), 0) as integer) as financed_base,
        cast(coalesce(max(case when f.doc_date is not null then 1 end), 0) as integer) as financed_wide,
        coalesce(max(case when datediff('day', s.sale_date, f.doc_date) <= 90 then f.amount end), 0.0) as mort_amt
        from sales s left join filings f on f.bbl = s.bbl and datediff('day', s.sale_date, f.doc_date) between -15 and 180 group by 1, 2, 3, 4, 5, 6, 7""",
    "pairs": f"""select * from (select bbl, borough, zipcode, src,
        lag(sale_id) over w as sale_id_a, sale_id as sale_id_z, lag(sale_date) over w as date_a, sale_date as date_z,
        lag(price) over w as price_a, price as price_z, lag(financed_strict) over w as financed_strict_a, financed_strict as financed_strict_z,
        lag(financed_base) over w as financed_base_a, financed_base as financed_base_z,
        lag(financed_wide) over w as financed_wide_a, financed_wide as financed_wide_z
        from flagged window w as (partition by bbl order by sale_date, sale_id)) where datediff('day', date_a, date_z) >= {HOLD}""",
}
WINDOWS = {"strict": (-15, 30), "base": (-15, 90), "wide": (-15, 180)}


class Tables:
    """The test tables and the roles that they play."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name in ROLES:
            used = {t: getattr(self, t) for t in set(re.findall(r"\{(\w+)\}", ROLES[name]))}
            return self.spark.sql(ROLES[name], **used)
        raise AttributeError(name)

    @cached_property
    def flagged(self) -> DataFrame:
        return linkage.window_flags(self.sales, self.filings, WINDOWS, amount_in="base")

    @cached_property
    def pairs(self) -> DataFrame:
        kept = ["sale_id", "sale_date", "price", "financed_strict", "financed_base", "financed_wide"]
        out = pairing.consecutive(
            self.flagged, "bbl", ["sale_date", "sale_id"], carry=kept, same=["borough", "zipcode", "src"], hold=HOLD, day="sale_date"
        )
        return out.withColumnsRenamed({"sale_date_a": "date_a", "sale_date_z": "date_z"})

    @cached_property
    def enriched(self) -> DataFrame:
        """Pairs with log growth, arm and switch dummies."""
        p = self.pairs
        cf, fc = measures.switched(p.financed_base_a, p.financed_base_z)
        y = measures.log_growth(p.price_a, p.price_z)
        return p.withColumns({"y": y, "arm": measures.arm(p.financed_base_a, p.financed_base_z), "cf": cf, "fc": fc})

    @cached_property
    def kept(self) -> DataFrame:
        """``enriched`` written down, for what reads the pairs more than once."""
        return written(self.enriched, "enriched")


ENRICHED_SQL = """select *, ln(price_z / price_a) as y, concat(case when financed_base_a = 1 then 'f' else 'c' end, case when financed_base_z = 1 then 'f' else 'c' end) as arm,
    cast(financed_base_a = 0 and financed_base_z = 1 as integer) as cf, cast(financed_base_a = 1 and financed_base_z = 0 as integer) as fc from pairs"""
VIEWS = {k: re.sub(r"\{(\w+)\}", r"\1", v) for k, v in ROLES.items()} | DERIVED | {"enriched": ENRICHED_SQL}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def with_views(sql: str) -> str:
    """The SQL behind the definitions of the views that it uses."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in needed and re.search(rf"\b(?:from|join)\s+{name}\b", text):
                needed.add(name)
                visit(VIEWS[name])

    visit(sql)
    defs = [f"{name} as ({VIEWS[name]})" for name in VIEWS if name in needed]
    body = sql.strip()
    if defs and body.lower().startswith("with "):
        return f"with {', '.join(defs)}, {body[5:]}"
    return f"with {', '.join(defs)} {body}" if defs else body


def query(name: str, sql: str | None = None):
    """Register a function of Tables as a query, with its SQL if there is one."""

    def register(f: Callable[[Tables], DataFrame]):
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = with_views(sql)
        return f

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, as engines sum in different orders."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
