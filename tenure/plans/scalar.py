"""Queries of the scalar projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from tenure.functions import cover, keys, measures, names
from tenure.operators import sampling

from .registry import query, rounded

ORDER_TEXT = "cast(o_orderkey as varchar)"


@query("p01_parcel_key", """select o_orderkey, case when o_orderkey % 5 = 0 then null else printf('%d%05d%04d', cast(1 + o_custkey % 5 as integer),
    cast(o_orderkey % 100000 as integer), cast(o_custkey % 12000 as integer)) end as bbl from orders""")
def p01(t):
    block = F.when(F.col("o_orderkey") % 5 == 0, F.lit("x1")).otherwise((F.col("o_orderkey") % 100000).cast("string"))
    lot = (F.col("o_custkey") % 12000).cast("string")
    return t.orders.select("o_orderkey", keys.compose_parcel((1 + F.col("o_custkey") % 5).cast("string"), block, lot).alias("bbl"))


@query("p02_parcel_from_number", "select o_orderkey, cast(4000000000 + o_custkey as varchar) as bbl from orders")
def p02(t):
    text = F.concat((F.lit(4000000000) + F.col("o_custkey")).cast("string"), F.lit(".00000000"))
    return t.orders.select("o_orderkey", keys.parcel_from_number(text).alias("bbl"))


@query("p03_day", """select o_orderkey, cast(o_orderdate as date) as day, cast(date_diff('day', date '1970-01-01', cast(o_orderdate as date)) as integer) as ordinal from orders""")
def p03(t):
    day = keys.day_of(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T00:00:00.000")))
    return t.orders.select("o_orderkey", day.alias("day"), F.unix_date(day).alias("ordinal"))


@query("p04_us_date", """select o_orderkey, case when o_orderkey % 7 = 0 then null when year(o_orderdate) < 1997 then null else cast(o_orderdate as date) end as day from orders""")
def p04(t):
    text = F.when(F.col("o_orderkey") % 7 == 0, F.lit("13/45/2016")).otherwise(F.date_format("o_orderdate", "MM/dd/yyyy"))
    return t.orders.select("o_orderkey", keys.us_date(text, 1997).alias("day"))


@query("p05_document_day", """select o_orderkey, case o_orderkey % 3 when 0 then cast(o_orderdate as date) when 1 then date '2016-02-03' else null end as day from orders""")
def p05(t):
    k = F.col("o_orderkey") % 3
    first = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).when(k == 1, "").otherwise(F.lit("2016-0"))
    return t.orders.select("o_orderkey", keys.document_day(first, F.lit("2016-02-03T10:00:00")).alias("day"))


@query("p06_unit", """select o_orderkey, case o_orderkey % 4 when 0 then trim(concat(cast(o_custkey % 90 as varchar), ' C')) when 1 then concat(cast(o_custkey % 90 as varchar), 'B 2')
    else '' end as unit from orders""")
def p06(t):
    k, n = F.col("o_orderkey") % 4, (F.col("o_custkey") % 90).cast("string")
    apartment = F.when(k == 0, F.concat(F.lit("  "), n, F.lit("   c "))).otherwise(F.lit(" "))
    address = F.when(k == 1, F.concat(F.lit("345 W 55TH ST, "), n, F.lit("b  2 "))).when(k == 2, F.lit("1 MAIN ST"))
    return t.orders.select("o_orderkey", keys.unit_key(apartment, address).alias("unit"))


@query("p07_quarter", "select o_orderkey, cast((year(o_orderdate) - 1996) * 4 + (month(o_orderdate) - 1) // 3 as integer) as q from orders")
def p07(t):
    return t.orders.select("o_orderkey", measures.quarter_index(F.col("o_orderdate"), 1996).alias("q"))


@query("p08_log_growth", "select sale_id_z, round(ln(price_z / price_a), 6) as y from pairs")
def p08(t):
    return rounded(t.pairs.select("sale_id_z", measures.log_growth(F.col("price_a"), F.col("price_z")).alias("y")))


@query("p09_holding_years", """select sale_id_z, round(date_diff('day', date_a, date_z) / 365.25, 6) as years, round(ln(price_z / price_a) / (date_diff('day', date_a, date_z) / 365.25), 6) as annual from pairs""")
def p09(t):
    years = measures.holding_years(F.col("date_a"), F.col("date_z"))
    y = measures.log_growth(F.col("price_a"), F.col("price_z"))
    return rounded(t.pairs.select("sale_id_z", years.alias("years"), measures.annual_growth(y, years).alias("annual")))


@query("p10_trend", "select sale_id, round(date_diff('day', date '2020-01-01', sale_date) / 365.25, 6) as trend from sales")
def p10(t):
    return rounded(t.sales.select("sale_id", measures.trend_years(F.col("sale_date")).alias("trend")))


@query("p11_previous_month", "select sale_id, cast(date_trunc('month', sale_date) - interval 1 month as date) as month from sales")
def p11(t):
    return t.sales.select("sale_id", measures.previous_month(F.col("sale_date")).alias("month"))


@query("p12_centred_log2", """with m as (select borough, cast(date_trunc('month', sale_date) as date) as month, cast(count(*) as bigint) as n from sales group by 1, 2)
    select borough, month, round(log2(n) - avg(case when month between date '1996-01-01' and date '1997-12-01' then log2(n) end) over (partition by borough), 6) as level from m""")
def p12(t):
    from tenure.sources.files import centred_log2

    m = t.sales.groupBy("borough", F.trunc("sale_date", "MM").alias("month")).agg(F.count("*").alias("n"))
    return rounded(centred_log2(m, "borough", "n", "1996-01-01", "1997-12-01").select("borough", "month", F.col("n_log2").alias("level")))


@query("p13_property_type", """select o_orderkey, case when o_custkey % 12 in (1, 2, 3) then 'house' when o_custkey % 12 in (9, 10) then 'coop' when o_custkey % 12 in (4, 11) then 'condo' end as type from orders""")
def p13(t):
    code = F.concat(F.lit(" "), F.format_string("%02d", F.col("o_custkey") % 12), F.lit(" CLASS"))
    types = {"house": ("01", "02", "03"), "coop": ("09", "10", "17"), "condo": ("04", "11", "12", "13", "15")}
    return t.orders.select("o_orderkey", measures.property_type(code, types).alias("type"))


@query("p14_period", """select case when sale_date < date '1997-04-01' then 'pre' when sale_date < date '1998-01-01' then 'transition' else 'post' end as period, count(*) as n from sales group by 1""")
def p14(t):
    return t.sales.groupBy(measures.period(F.col("sale_date"), "1997-04-01", "1998-01-01").alias("period")).agg(F.count("*").alias("n"))


@query("p15_arm", "select sale_id_z, arm, cf, fc from enriched")
def p15(t):
    return t.enriched.select("sale_id_z", "arm", "cf", "fc")


@query("p16_tax_burden", """select sale_id, round(case when mort_amt / price > 0.05 and mort_amt / price <= 1.05 then (case when mort_amt < 500000 then 0.018 else 0.01925 end) * mort_amt / price end, 6) as burden from flagged""")
def p16(t):
    return rounded(t.flagged.select("sale_id", measures.tax_burden(F.col("mort_amt"), F.col("price")).alias("burden")))


@query("p17_inversion", """with b as (select (avg(case when cf = 1 then y end) - avg(case when fc = 1 then y end)) / 2 as p from enriched)
    select cast(q as double) as q, round((exp(p) - 1) * (1 - q) / q, 6) as discount from b, (select unnest([0.1, 0.2, 0.3, 0.5]) as q)""")
def p17(t):
    from tenure.operators.summary import half_difference

    b = half_difference(t.enriched, "arm", "y").select(F.col("half_difference").alias("p"))
    q = b.select("p", F.explode(F.array(*[F.lit(x) for x in (0.1, 0.2, 0.3, 0.5)])).alias("q"))
    return rounded(q.select("q", measures.invert_discount(F.col("p"), F.col("q")).alias("discount")))


@query("p18_denial_rate", """select n_name, round(cast(sum(case when l_returnflag = 'R' then 1 else 0 end) as double) / sum(case when l_returnflag in ('R', 'A') then 1 else 0 end), 6) as rate
    from lineitem join supplier on s_suppkey = l_suppkey join nation on n_nationkey = s_nationkey group by 1""")
def p18(t):
    rows = t.lineitem.join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey")).join(F.broadcast(t.nation), F.col("n_nationkey") == F.col("s_nationkey"))
    count = lambda k: F.count(F.when(F.col("l_returnflag") == k, 1)).cast("double")
    return rounded(rows.groupBy("n_name").agg(measures.denial_rate(count("A"), count("R")).alias("rate")))


@query("p19_verdict", """with s as (select borough, avg(y) as m, stddev_samp(y) / sqrt(count(*)) as se from enriched group by 1)
    select borough, case when m - 1.96 * se > 0 then 'above' when m + 1.96 * se < 0 then 'below' else 'spans' end as verdict from s""")
def p19(t):
    s = t.enriched.groupBy("borough").agg(F.avg("y").alias("m"), (F.stddev_samp("y") / F.sqrt(F.count("*"))).alias("se"))
    return s.select("borough", measures.verdict(F.col("m") - 1.96 * F.col("se"), F.col("m") + 1.96 * F.col("se"), 0).alias("verdict"))


@query("p20_street_key", """select c_custkey, case c_custkey % 4 when 0 then concat(cast(c_custkey as varchar), ' MAIN ST') when 1 then null when 2 then null
    else concat(cast(c_custkey as varchar), ' ELM AVE WEST') end as street, case when c_custkey % 4 in (0, 3) then 'NEW YORK' end as city, case when c_custkey % 4 in (0, 3) then '10027' end as zip from customer""")
def p20(t):
    k, n = F.col("c_custkey") % 4, F.col("c_custkey").cast("string")
    address = F.when(k == 0, F.concat(n, F.lit(" Main Street Apt 4"))).when(k == 1, F.concat(F.lit("PO BOX "), n))
    address = address.when(k == 2, F.lit("MAIN ST")).otherwise(F.concat(n, F.lit(" ELM AVENUE, WEST")))
    return t.customer.select("c_custkey", names.street_key(address, F.lit("New-York"), F.lit("10027-1234")).alias("k")).select("c_custkey", "k.*")


@query("p21_surname", r"""select document_id, party_type, case when not regexp_matches(upper(trim(name)), '\b(LLC|CORP|TRUST|BANK|HOLDINGS|ASSOCIATION)\b') and contains(name, ',')
    and length(trim(split_part(upper(trim(name)), ',', 1))) > 1 then trim(split_part(upper(trim(name)), ',', 1)) end as surname from parties""")
def p21(t):
    return t.parties.select("document_id", "party_type", names.surname(F.col("name")).alias("surname"))


@query("p22_party_category", r"""select document_id, party_type, case when count(case when name <> '' then 1 end) = 0 then 'unknown'
    when bool_or(regexp_matches(name, '(?i)\b(LLC|HOLDINGS|CORP|BANK)\b')) then 'entity' when bool_or(regexp_matches(name, '(?i)\bTRUST\b')) then 'trust' else 'person' end as category
    from parties group by 1, 2""")
def p22(t):
    from tenure.operators.parties import names_by_role

    return names_by_role(t.parties).select("document_id", "party_type", names.party_category(F.col("names")).alias("category"))


@query("p23_lender_flags", r"""select name, regexp_matches(name, '(?i)\bUS BANK\b') as high, regexp_matches(name, '(?i)\b(BANK|NATIONAL ASSOCIATION)\b') as broad, count(*) as n from parties group by 1""")
def p23(t):
    n = F.col("name")
    return t.parties.groupBy("name").agg(F.count("*").alias("n")).select("name", names.lender_high(n).alias("high"), names.lender_broad(n).alias("broad"), "n")


@query("p24_truthy", "select sale_id, sale_id % 3 <> 2 as flag from sales")
def p24(t):
    k = F.col("sale_id") % 3
    return t.sales.select("sale_id", keys.truthy(F.when(k == 0, "True").when(k == 1, "1").otherwise("no")).alias("flag"))


@query("p25_zip", """select sale_id, case when sale_id % 4 = 3 then '1001' else cast(10000 + sale_id % 90 as varchar) end as zip, sale_id % 4 in (0, 1) as linked from sales""")
def p25(t):
    k, z = F.col("sale_id") % 4, (10000 + F.col("sale_id") % 90).cast("string")
    clean = keys.zip_clean(F.when(k == 0, F.concat(z, F.lit(".0"))).when(k == 3, "1001").otherwise(z))
    return t.sales.select("sale_id", clean.alias("zip"), keys.geo_linked(clean, F.when(k < 2, "101").otherwise("")).alias("linked"))


@query("p26_case_ids", """select sale_id, printf('H%03d', cast(sale_id % 2000 as integer)) as case_id, concat('https://example.org/doc?id=', cast(sale_id as varchar)) as url from sales""")
def p26(t):
    url = keys.document_url(F.col("sale_id").cast("string"), "https://example.org/doc?id=")
    return t.sales.select("sale_id", keys.case_id(F.col("sale_id") % 2000).alias("case_id"), url.alias("url"))


@query("p27_amount_tolerance", """select s.sale_id, count(case when amount > 0 and abs(amount - price) <= greatest(1, price * 0.01) then 1 end) as within_1pct,
    count(case when amount > 0 and abs(amount - price) <= price * 0.005 then 1 end) as within_half from sales s join filings f on f.bbl = s.bbl group by 1""")
def p27(t):
    a, p = F.col("amount"), F.col("price")
    hit = lambda m: F.count(F.when(m, 1))
    return t.sales.join(t.filings, "bbl").groupBy("sale_id").agg(
        hit(measures.amount_matches(a, p)).alias("within_1pct"), hit(measures.amount_matches(a, p, 0.005, None)).alias("within_half")
    )


@query("p28_round_dummies", """select low, cast(round_even((low + 5000) / 10000, 0) * 10000 % 100000 = 0 as integer) as r100, cast(round_even((low + 5000) / 10000, 0) * 10000 % 50000 = 0 as integer) as r50,
    cast(ceil(low / 100000) * 100000 < low + 10000 as integer) as e100, cast(ceil(low / 50000) * 50000 < low + 10000 and not ceil(low / 100000) * 100000 < low + 10000 as integer) as e50
    from (select distinct cast(floor(price / 10000) * 10000 as double) as low from sales)""")
def p28(t):
    low = F.col("low")
    a, b, _ = measures.round_dummies(low + 5000, 10_000)
    c, d, _ = measures.exclusive_round_dummies(low, low + 10_000)
    rows = t.sales.select((F.floor(F.col("price") / 10_000) * 10_000).cast("double").alias("low")).distinct()
    return rows.select("low", a.alias("r100"), b.alias("r50"), c.alias("e100"), d.alias("e50"))


@query("p29_cover_page", """select o_orderkey, 1000 + k % 9000 + 0.25 as state_tax, round((1000 + k % 9000 + 0.25) / 0.004, 4) as consideration, o_orderkey % 2 = 0 as same_address
    from (select cast(o_orderkey as double) as k, * from orders)""")
def p29(t):
    tax = F.format_number(1000 + F.col("o_orderkey") % 9000 + 0.25, 2)
    other = F.when(F.col("o_orderkey") % 2 == 0, "12 Main St., Apt-4").otherwise("9 ELM")
    text = F.concat(F.lit("GRANTOR ADDRESS: 12 MAIN ST APT 4\nGRANTEE ADDRESS: "), other, F.lit("\nNYS Real Estate Transfer Tax:\n $ "), tax, F.lit("\n"))
    out = t.orders.select("o_orderkey", cover.parse_cover(text).alias("c")).select("o_orderkey", "c.state_tax", "c.consideration", "c.same_address")
    return out.withColumn("consideration", F.round("consideration", 4))


@query("p30_number", "select o_orderkey, case when o_orderkey % 3 = 0 then 0.0 else cast(o_totalprice as double) end as v from orders")
def p30(t):
    text = F.when(F.col("o_orderkey") % 3 == 0, "n/a").otherwise(F.col("o_totalprice").cast("double").cast("string"))
    return t.orders.select("o_orderkey", keys.number_or(text).alias("v"))


@query("p31_perturbation", "select sale_id_z, round(y - case when sale_id_z % 4 = 0 then sign(y) * 0.5 else 0 end, 6) as y from enriched")
def p31(t):
    y = measures.perturbed(F.col("y"), F.col("y"), F.col("sale_id_z") % 4 == 0, 0.5)
    return rounded(t.enriched.select("sale_id_z", y.alias("y")))


@query("p32_standardised", """select sale_id_z, round((y - avg(y) over (partition by borough)) / stddev_pop(y) over (partition by borough), 6) as z_pop,
    round((y - avg(y) over (partition by borough)) / stddev_samp(y) over (partition by borough), 6) as z_samp from enriched""")
def p32(t):
    from pyspark.sql import Window

    w = Window.partitionBy("borough")
    d = F.col("y") - F.avg("y").over(w)
    return rounded(t.enriched.select("sale_id_z", (d / F.stddev_pop("y").over(w)).alias("z_pop"), (d / F.stddev_samp("y").over(w)).alias("z_samp")))


@query("p33_relabel", """select sale_id, case when substr(md5(concat('5:', cast(sale_id as varchar))), 1, 1) = '0' then 1 - financed_base else financed_base end as flipped,
    case when substr(md5(concat('5:', cast(sale_id as varchar))), 1, 1) = '0' then 1 else financed_base end as filled from flagged""")
def p33(t):
    chosen = t.flagged.where(F.substring(sampling.hash_key(F.col("sale_id"), 5), 1, 1) == "0").select("sale_id", F.lit(True).alias("sel"))
    rows = t.flagged.join(chosen, "sale_id", "left")
    sel = F.coalesce("sel", F.lit(False))
    f = F.col("financed_base")
    return rows.select("sale_id", measures.relabelled(f, sel).alias("flipped"), measures.relabelled(f, sel, 1).alias("filled"))
