"""Queries of the filters and screens."""

from __future__ import annotations

from pyspark.sql import functions as F

from tenure.operators import linkage, screens

from .registry import query, rounded


@query("f01_type_and_borough", "select sale_id, src from sales where borough <> '4' and src in ('BUILDING', 'MACHINERY')")
def f01(t):
    return t.sales.where((F.col("borough") != "4") & F.col("src").isin("BUILDING", "MACHINERY")).select("sale_id", "src")


@query("f02_headline_mask", """select sale_id_z from enriched p where not exists (select 1 from permits q where q.bbl = p.bbl and issued between date_a and date_z)
    and not (sale_id_z % 11 = 0) and regexp_matches(lpad(zipcode, 5, '1'), '^\\d{5}$')""")
def f02(t):
    from tenure.functions.keys import geo_linked

    rows = linkage.flag_between(t.enriched, t.permits, "bbl", "date_a", "date_z", "issued", "has_permit")
    mask = screens.headline(~F.col("has_permit"), F.col("sale_id_z") % 11 == 0, geo_linked(F.lpad("zipcode", 5, "1"), F.lit("101")))
    return rows.where(mask).select("sale_id_z")


@query("f03_cumulative_masks", """select count(*) as all_pairs, count(case when borough <> '4' then 1 end) as s1, count(case when borough <> '4' and financed_wide_a >= financed_base_a and price_a > 50000 then 1 end) as s2,
    count(case when borough <> '4' and price_a > 50000 and y between -1 and 1 then 1 end) as s3 from enriched""")
def f03(t):
    masks = {"s1": F.col("borough") != "4", "s2": F.col("price_a") > 50_000, "s3": F.col("y").between(-1, 1)}
    rows = screens.cumulative(t.enriched, masks)
    return rows.agg(F.count("*").alias("all_pairs"), *[F.count(F.when(F.col(m), 1)).alias(m) for m in masks])


@query("f04_drop_reasons", """select case when length(lpad(bbl, 10, '0')) <> 10 then 'bad key' when src not in ('BUILDING', 'MACHINERY', 'FURNITURE') then 'other class'
    when price < 20000 then 'low price' end as dropped, count(*) as n from sales group by 1""")
def f04(t):
    reasons = {"bad key": F.length(F.lpad("bbl", 10, "0")) != 10, "other class": ~F.col("src").isin("BUILDING", "MACHINERY", "FURNITURE"), "low price": F.col("price") < 20_000}
    return screens.drop_reasons(t.sales, reasons).groupBy("dropped").agg(F.count("*").alias("n"))


@query("f05_eligible", """select sale_id from sales where price * 10 > 300000 and price * 10 < 6000000 and sale_date + interval 20 year between date '2016-01-01' and date '2025-12-31' and borough <> '5' and src <> ''""")
def f05(t):
    ok = screens.eligible_sale(F.col("price") * 10, F.add_months("sale_date", 240), F.col("borough"), F.col("src"))
    return t.sales.where(ok).select("sale_id")


@query("f06_lot_kind", """select case when l between 1001 and 1999 then 'unit' when l between 1 and 7499 then 'house' end as kind, count(*) as n from (select o_custkey * 7 % 9000 as l from orders where o_totalprice > 0) group by 1""")
def f06(t):
    rows = t.orders.where("o_totalprice > 0").select(screens.lot_kind(F.col("o_custkey") * 7 % 9000).alias("kind"))
    return rows.groupBy("kind").agg(F.count("*").alias("n"))


@query("f07_document_types", "select doc_type, count(*) as n from filings where doc_type in ('R', 'A') group by 1")
def f07(t):
    return t.filings.where(F.col("doc_type").isin("R", "A")).groupBy("doc_type").agg(F.count("*").alias("n"))


@query("f08_bottom_quantile", """with q as (select borough, year(sale_date) as y, quantile_cont(price, 0.1) as cut, count(*) as n from sales group by 1, 2)
    select sale_id from sales s join q on q.borough = s.borough and q.y = year(s.sale_date) where n <= 50 or price >= cut""")
def f08(t):
    rows = t.sales.withColumn("year", F.year("sale_date"))
    return screens.above_group_quantile(rows, "price", ["borough", "year"], 0.1).select("sale_id")


@query("f09_common_support", """with q as (select src, quantile_cont(price, 0.1) as l, quantile_cont(price, 0.9) as h from sales group by 1)
    select src, count(*) as n from sales where price between (select max(l) from q) and (select min(h) from q) group by 1""")
def f09(t):
    return screens.common_support(t.sales, "price", "src").groupBy("src").agg(F.count("*").alias("n"))


@query("f10_terciles", """with q as (select src, quantile_cont(price_a, 0.333) as a, quantile_cont(price_a, 0.667) as b from pairs group by 1)
    select p.src, cast(case when price_a < a then 1 when price_a < b then 2 else 3 end as integer) as tercile, count(*) as n from pairs p join q on q.src = p.src group by 1, 2""")
def f10(t):
    return screens.terciles(t.pairs, "price_a", "src").groupBy("src", "tercile").agg(F.count("*").alias("n"))


@query("f11_varying_parcels", """select sale_id from (select *, sum(financed_strict) over (partition by bbl) as s, count(*) over (partition by bbl) as n from flagged) where n >= 2 and s > 0 and s < n""")
def f11(t):
    return screens.varying(t.flagged, "bbl", "financed_strict").select("sale_id")


@query("f12_trim", """select sale_id_z from enriched where y between (select quantile_cont(y, 0.01) from enriched) and (select quantile_cont(y, 0.99) from enriched)""")
def f12(t):
    return screens.trimmed(t.enriched, "y", 0.01).select("sale_id_z")


@query("f13_weighted_trim", """with c as (select borough, sale_id_z, y, cast(1 + sale_id_z % 3 as double) as w from enriched),
    d as (select *, (sum(w) over (partition by borough order by y rows unbounded preceding) - w / 2) / sum(w) over (partition by borough) as cdf from c),
    e as (select *, lead(cdf) over (partition by borough order by cdf) as c1, lead(y) over (partition by borough order by cdf) as y1, row_number() over (partition by borough order by cdf) as r from d),
    q as (select borough, s, min(case when s < cdf then y when c1 is null then y else y + (y1 - y) * (s - cdf) / (c1 - cdf) end) as v from e, (select unnest([0.01, 0.99]) as s)
        where (s >= cdf and s < c1) or (r = 1 and s < cdf) or (c1 is null and s >= cdf) group by 1, 2),
    b as (select borough, min(v) as l, max(v) as h from q group by 1)
    select c.borough, count(*) as n from c join b on b.borough = c.borough where y between l and h group by 1""")
def f13(t):
    rows = t.enriched.withColumn("w", (1 + F.col("sale_id_z") % 3).cast("double"))
    return screens.trimmed_weighted(rows, "y", "w", 0.01, 0.99, "borough").groupBy("borough").agg(F.count("*").alias("n"))


@query("f14_without_influential", """select count(*) as n, round(avg(y), 6) as mean from enriched where bbl not in (select bbl from enriched order by abs(y) desc, sale_id_z limit 60)""")
def f14(t):
    rows = screens.without_top(t.enriched, "bbl", [F.desc(F.abs("y")), F.col("sale_id_z")], 60)
    return rounded(rows.agg(F.count("*").alias("n"), F.avg("y").alias("mean")))


@query("f15_leave_one_out", """select w as without, count(*) as n, round(avg(y), 6) as mean from enriched, (select unnest(['0', '1', '2', '3', '4']) as w) where borough <> w group by 1""")
def f15(t):
    return rounded(screens.leave_one_out(t.enriched, "borough", list("01234"), F.count("*").alias("n"), F.avg("y").alias("mean")))


@query("f16_safeguards", """select sale_id_z from enriched where financed_strict_a <= financed_base_a and date_a <> date_z and price_a > 0 and not (financed_base_z = 1 and financed_wide_z = 0)
    and bbl not in (select bbl from flagged group by bbl, sale_date having count(*) > 1)""")
def f16(t):
    twice = t.flagged.groupBy("bbl", "sale_date").count().where("count > 1").select("bbl").distinct()
    sure = screens.all_of(
        F.col("financed_strict_a") <= F.col("financed_base_a"), F.col("date_a") != F.col("date_z"), F.col("price_a") > 0,
        ~((F.col("financed_base_z") == 1) & (F.col("financed_wide_z") == 0)),
    )
    return t.enriched.where(sure).join(twice, "bbl", "left_anti").select("sale_id_z")


@query("f17_support_status", """select borough, case when count(*) < 1100 then 'too few pairs' when least(sum(cf), sum(fc)) < 280 then 'too few switchers' else 'ok' end as status from enriched group by 1""")
def f17(t):
    rows = t.enriched.groupBy("borough").agg(F.count("*").alias("n"), F.sum("cf").alias("cf"), F.sum("fc").alias("fc"))
    return rows.select("borough", screens.support_status(F.col("n"), F.col("cf"), F.col("fc"), 1100, 280).alias("status"))


@query("f18_nested_windows", """select count(case when financed_strict > financed_base or financed_base > financed_wide then 1 end) as violations, count(*) as rows from flagged""")
def f18(t):
    return screens.nested_violations(t.flagged, "financed_strict", "financed_base", "financed_wide")


@query("f19_delayed_financing", """select count(case when financed_base = 0 and financed_wide = 1 then 1 end) as delayed, count(case when financed_strict <> financed_wide then 1 end) as sensitive,
    round(avg(case when financed_base = 0 and financed_wide = 1 then price end), 4) as mean_price from flagged""")
def f19(t):
    late = (F.col("financed_base") == 0) & (F.col("financed_wide") == 1)
    return rounded(t.flagged.agg(
        F.count(F.when(late, 1)).alias("delayed"), F.count(F.when(F.col("financed_strict") != F.col("financed_wide"), 1)).alias("sensitive"),
        F.avg(F.when(late, F.col("price"))).alias("mean_price"),
    ), 4)
