"""Queries of the aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tenure.functions import measures
from tenure.operators import density, estimation, linkage, parties, summary

from .registry import WINDOWS, query, rounded

GAP = "date_diff('day', s.sale_date, f.doc_date)"
COUNT = "cast(count({}) as bigint)"


@query("g01_by_parcel", "select bbl, min(sale_id_z) as first_sale, count(*) as n, round(sum(abs(y)), 6) as total from enriched group by 1")
def g01(t):
    return rounded(t.enriched.groupBy("bbl").agg(F.min("sale_id_z").alias("first_sale"), F.count("*").alias("n"), F.sum(F.abs("y")).alias("total")))


@query("g02_counts", "select bbl, sale_date, count(*) as n from sales group by 1, 2")
def g02(t):
    return t.sales.groupBy("bbl", "sale_date").agg(F.count("*").alias("n"))


@query("g03_crosstab", """select financed_strict, count(case when financed_wide = 0 then 1 end) as financed_wide_0, count(case when financed_wide = 1 then 1 end) as financed_wide_1 from flagged group by 1""")
def g03(t):
    return summary.crosstab(t.flagged, "financed_strict", "financed_wide", [0, 1])


@query("g04_frequencies", "select src, borough, count(*) as n from sales group by 1, 2")
def g04(t):
    return t.sales.groupBy("src", "borough").agg(F.count("*").alias("n"))


@query("g05_name_audit", r"""select name, party_type, regexp_matches(name, '(?i)\bUS BANK\b') as high, regexp_matches(name, '(?i)\b(BANK|NATIONAL ASSOCIATION)\b') as broad, count(*) as n from parties
    where regexp_matches(name, '(?i)\b(US BANK|BANK|NATIONAL ASSOCIATION)\b') group by 1, 2""")
def g05(t):
    return parties.lender_audit(t.parties)


@query("g06_common_surnames", r"""with n as (select document_id, party_type, case when not regexp_matches(upper(trim(name)), '\b(LLC|CORP|TRUST|BANK|HOLDINGS|ASSOCIATION)\b') and contains(name, ',')
    and length(trim(split_part(upper(trim(name)), ',', 1))) > 1 then trim(split_part(upper(trim(name)), ',', 1)) end as surname from parties)
    select surname, count(*) as count from (select distinct * from n where surname is not null) group by 1 order by count(*) desc, surname limit 40""")
def g06(t):
    from tenure.functions.names import surname

    return summary.common_names(t.parties.withColumn("surname", surname(F.col("name"))), ["document_id", "party_type"], "surname", 40)


@query("g07_distinct", "select count(distinct bbl) as parcels, count(distinct sale_date) as days, count(distinct zipcode) as zips from sales")
def g07(t):
    return t.sales.agg(F.count_distinct("bbl").alias("parcels"), F.count_distinct("sale_date").alias("days"), F.count_distinct("zipcode").alias("zips"))


@query("g08_percentiles", "select borough, round(quantile_cont(price, 0.025), 6) as low, round(median(price), 6) as median, round(quantile_cont(price, 0.975), 6) as high from sales group by 1")
def g08(t):
    return rounded(summary.percentiles(t.sales, "price", {"low": 0.025, "median": 0.5, "high": 0.975}, ["borough"]))


@query("g09_shares", "select arm, round(avg(cast(price_a > 200000 as integer)), 6) as high_a, round(avg(cast(y > 0.7 as integer)), 6) as tail from enriched group by 1")
def g09(t):
    return rounded(summary.shares(t.enriched, {"high_a": F.col("price_a") > 200_000, "tail": F.col("y") > 0.7}, ["arm"]))


@query("g10_cluster_sums", """with m as (select avg(case when cf = 1 then y end) as a, avg(case when fc = 1 then y end) as b, sum(cf) as nc, sum(fc) as nf from enriched)
    select bbl, round(sum(0.5 * (cf * (y - a) / nc - fc * (y - b) / nf)), 9) as influence from enriched, m group by 1""")
def g10(t):
    m = t.enriched.agg(
        F.avg(F.when(F.col("cf") == 1, F.col("y"))).alias("a"), F.avg(F.when(F.col("fc") == 1, F.col("y"))).alias("b"), F.sum("cf").alias("nc"), F.sum("fc").alias("nf")
    )
    rows = t.enriched.crossJoin(F.broadcast(m))  # one row
    score = 0.5 * (F.col("cf") * (F.col("y") - F.col("a")) / F.col("nc") - F.col("fc") * (F.col("y") - F.col("b")) / F.col("nf"))
    return rounded(rows.groupBy("bbl").agg(F.sum(score).alias("influence")), 9)


@query("g11_name_sets", """select document_id, party_type, coalesce(array_to_string(list_sort(list(distinct upper(trim(name))) filter (where trim(name) <> '')), '|'), '') as names from parties group by 1, 2""")
def g11(t):
    return parties.names_by_role(t.parties).withColumn("names", F.array_join(F.sort_array("names"), "|"))


@query("g12_one_parcel_documents", "select doc_id, min(bbl) as bbl from filings group by 1 having count(distinct bbl) = 1")
def g12(t):
    return linkage.single_parcel(t.filings.select("doc_id").distinct(), t.filings, "doc_id").select("doc_id", "bbl")


@query("g13_cell_support", """with e as (select zipcode as area, year(date_a) as y from pairs union all select zipcode, year(date_z) from pairs), c as (select area, y, count(*) as n from e group by 1, 2)
    select count(distinct area) as areas, count(*) as cells, count(case when n < 20 then 1 end) as thin, cast(median(n) as double) as median from c""")
def g13(t):
    return summary.cell_support(t.pairs, "zipcode", {"a": "date_a", "z": "date_z"}, 20)


@query("g14_histogram", """with b as (select cast(unnest(range(0, 60)) as integer) as bin), c as (select cast(floor((price + 0.0) / 10000) as integer) as bin, count(*) as n from sales where price >= 0 and price < 600000 group by 1)
    select b.bin, cast(b.bin * 10000 as double) as low, coalesce(n, 0) as n from b left join c on c.bin = b.bin""")
def g14(t):
    return density.bins(t.sales, "price", 0.0, 600_000.0, 10_000)


@query("g15_exact_and_near", """with x as (select cast(th as double) as threshold, round(price, -3) as p from sales, (select unnest([100000, 200000, 300000]) as th))
    select threshold, count(case when p = threshold then 1 end) as at, count(case when p = threshold - 1 then 1 end) as one_below, count(case when p < threshold and p >= threshold - 1000 then 1 end) as within_1k,
    count(case when p < threshold and p >= threshold - 5000 then 1 end) as within_5k, round(count(case when p < threshold and p >= threshold - 5000 then 1 end) / cast(count(*) as double), 6) as just_under,
    round(cast(count(case when p = threshold - 1 then 1 end) as double) / nullif(count(case when p in (threshold - 1, threshold) then 1 end), 0), 6) as charm
    from x where p >= threshold - 50000 and p < threshold + 50000 group by 1""")
def g15(t):
    rows = t.sales.withColumn("p", F.round("price", -3))
    return rounded(density.near_counts(rows, "p", [100_000, 200_000, 300_000]))


@query("g16_spike_ratio", """select count(case when price > 190000 and price <= 200000 then 1 end) as spike, round(count(case when price > 190000 and price <= 200000 then 1 end) / (count(case when fmod(price, 10000) <> 0 then 1 end) * 0.05), 6) as ratio
    from sales where price >= 100000 and price < 300000""")
def g16(t):
    return rounded(density.spike_ratio(t.sales, "price", 200_000, 100_000))


@query("g17_charm_share", """select src, round(cast(count(case when p = 99 then 1 end) as double) / nullif(count(case when p in (99, 0) then 1 end), 0), 6) as charm from (select src, cast(floor(price) as bigint) % 100 as p from sales) group by 1""")
def g17(t):
    p = F.pmod(F.floor("price"), F.lit(100))
    count = lambda *v: F.count(F.when(p.isin(*v), 1))
    return rounded(t.sales.groupBy("src").agg(F.try_divide(count(99).cast("double"), count(99, 0)).alias("charm")))


@query("g18_above_below", """with r as (select case when sale_date < date '1998-01-01' then 'pre' else 'post' end as period, count(case when price >= 200000 and price < 250000 then 1 end) as above, count(case when price < 200000 and price >= 150000 then 1 end) as below from sales group by 1)
    select period, above, below, round(cast(above as double) / below, 6) as ratio from r""")
def g18(t):
    rows = t.sales.withColumn("period", F.when(F.col("sale_date") < "1998-01-01", "pre").otherwise("post"))
    return rounded(density.above_below(rows, "price", "period", 200_000, 50_000))


@query("g19_profile", "select src, count(*) as n, round(quantile_cont(price, 0.25), 6) as p25, round(quantile_cont(price, 0.5), 6) as median, round(quantile_cont(price, 0.75), 6) as p75, round(avg(price), 4) as mean from sales group by 1")
def g19(t):
    return rounded(summary.profile(t.sales, "price", ["src"])).withColumn("mean", F.round("mean", 4))


@query("g20_bracket_creep", "select cast(year(sale_date) as integer) as year, round(avg(cast(price >= 200000 as integer)), 6) as above, round(median(price), 6) as median from sales group by 1")
def g20(t):
    return rounded(t.sales.groupBy(F.year("sale_date").alias("year")).agg(F.avg((F.col("price") >= 200_000).cast("int")).alias("above"), F.median("price").alias("median")))


@query("g21_any_all", "select sale_id, financed_strict = 1 or price > 300000 as any_of, financed_strict = 1 and price > 300000 as all_of from flagged")
def g21(t):
    from tenure.operators.screens import all_of, any_of

    c = (F.col("financed_strict") == 1, F.col("price") > 300_000)
    return t.flagged.select("sale_id", any_of(*c).alias("any_of"), all_of(*c).alias("all_of"))


@query("g22_window_agreement", """with u as (unpivot (select src, financed_strict, financed_base, financed_wide from flagged) on financed_strict, financed_base, financed_wide into name win value f)
    select src, replace(win, 'financed_', '') as win, round(avg(f), 6) as share from u group by 1, 2""")
def g22(t):
    u = t.flagged.select("src", *[F.col(f"financed_{w}").alias(w) for w in WINDOWS]).unpivot("src", list(WINDOWS), "win", "f")
    return rounded(u.groupBy("src", "win").agg(F.avg("f").alias("share")))


@query("g23_transition_statistics", "select arm, round(avg(y), 6) as mean, round(stddev_samp(y) / sqrt(count(*)), 6) as se, count(*) as n from enriched group by 1")
def g23(t):
    return rounded(summary.transition_statistics(t.enriched, "arm", "y"))


@query("g23_half_difference", """select borough, round((avg(y) filter (arm = 'cf') - avg(y) filter (arm = 'fc')) / 2, 6) as half_difference, round(avg(y) filter (arm = 'cf') + avg(y) filter (arm = 'fc'), 6) as asymmetry,
    round((avg(y) filter (arm = 'cf') + avg(y) filter (arm = 'fc')) / sqrt(var_samp(y) filter (arm = 'cf') / count(*) filter (arm = 'cf') + var_samp(y) filter (arm = 'fc') / count(*) filter (arm = 'fc')), 5) as z,
    count(*) filter (arm = 'cf') as cf, count(*) filter (arm = 'fc') as fc from enriched group by 1""")
def g23_half(t):
    return rounded(summary.half_difference(t.enriched, "arm", "y", ["borough"])).withColumn("z", F.round("z", 5))


@query("g24_direction_profile", """select arm, round(median(date_diff('day', date_a, date_z)), 6) as gap, round(avg(cast(date_diff('day', date_a, date_z) < 365 as integer)), 6) as short, round(median(price_a), 6) as first_price from enriched where arm in ('cf', 'fc') group by 1""")
def g24(t):
    gap = F.datediff("date_z", "date_a")
    rows = t.enriched.where(F.col("arm").isin("cf", "fc"))
    return rounded(rows.groupBy("arm").agg(F.median(gap).alias("gap"), F.avg((gap < 365).cast("int")).alias("short"), F.median("price_a").alias("first_price")))


@query("g25_wilson", """with s as (select source, cast(sum(quality) as double) as h, cast(count(*) as double) as n from labels join documents on documents.doc_id = labels.doc_id group by 1)
    select source, round((h / n + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(h / n * (1 - h / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n), 6) as low,
    round((h / n + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt(h / n * (1 - h / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n), 6) as high from s""")
def g25(t):
    s = t.labels.join(t.documents.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("quality").alias("h"), F.count("*").alias("n"))
    low, high = measures.wilson(F.col("h"), F.col("n"))
    return rounded(s.select("source", low.alias("low"), high.alias("high")))


@query("g26_agreement", """with x as (select quality as t, cast(n_chars >= 600 as integer) as r from labels join documents on documents.doc_id = labels.doc_id)
    select count(case when t = 1 and r = 1 then 1 end) as tp, count(case when t = 0 and r = 1 then 1 end) as fp, count(case when t = 1 and r = 0 then 1 end) as fn, count(case when t = 0 and r = 0 then 1 end) as tn,
    round(avg(cast(t = r as integer)), 6) as agree from x""")
def g26(t):
    x = t.labels.join(t.documents, "doc_id").select("quality", (F.col("n_chars") >= 600).cast("int").alias("rule"))
    return rounded(summary.agreement(x, "quality", "rule").drop("low", "high"))


@query("g26_weighted_error", """with x as (select cast(quality <> cast(n_chars >= 600 as integer) as integer) as e, cast(1 + n_chars % 3 as double) as w from labels join documents on documents.doc_id = labels.doc_id)
    select round(sum(e * w) / sum(w), 6) as error, sum(w) as weight from x""")
def g26_weighted(t):
    x = t.labels.join(t.documents, "doc_id").select(
        (F.col("quality") != (F.col("n_chars") >= 600).cast("int")).cast("int").alias("e"), (1 + F.col("n_chars") % 3).cast("double").alias("w")
    )
    return rounded(summary.weighted_error(x, "e", "w"))


@query("g27_review_summary", "select quality, count(case when toxic = 1 then 1 end) as yes, count(case when toxic = 0 then 1 end) as no, count(*) as n from labels group by 1")
def g27(t):
    yes = F.col("toxic") == 1
    return t.labels.groupBy("quality").agg(F.count(F.when(yes, 1)).alias("yes"), F.count(F.when(~yes, 1)).alias("no"), F.count("*").alias("n"))


@query("g28_filing_reuse", f"""with h as (select s.sale_id, f.doc_id from sales s join filings f on f.bbl = s.bbl and {GAP} between -15 and 90), o as (select sale_id, min(doc_id) as d from h group by 1 having count(*) = 1)
    select max(n) as reuse, count(*) as filings from (select d, count(*) as n from o group by 1)""")
def g28(t):
    m = linkage.mutual_unique(t.sales, t.filings, -15, 90).where("doc_id is not null")
    return m.groupBy("doc_id").agg(F.count("*").alias("n")).agg(F.max("n").alias("reuse"), F.count("*").alias("filings"))


@query("g29_audit_counters", "select count(case when price < 50000 then 1 end) as low, count(case when price > 400000 then 1 end) as high, count(case when src = 'BUILDING' then 1 end) as building from sales")
def g29(t):
    p = F.col("price")
    return summary.audit_counts(t.sales, {"low": p < 50_000, "high": p > 400_000, "building": F.col("src") == "BUILDING"})


@query("g30_coverage", """with d as (select distinct bbl from filings where amount > 95000) select count(*) as endpoints, count(d.bbl) as covered from (select bbl from pairs union all select bbl from pairs) e left join d on d.bbl = e.bbl""")
def g30(t):
    ends = t.pairs.select("bbl").unionAll(t.pairs.select("bbl"))
    known = t.filings.where("amount > 95000").select("bbl").distinct().withColumn("c", F.lit(1))
    return ends.join(known, "bbl", "left").agg(F.count("*").alias("endpoints"), F.count("c").alias("covered"))


@query("m02_time_design", """with e as (select sale_id_z, borough, date_a as d, -1.0 as v from pairs union all select sale_id_z, borough, date_z, 1.0 from pairs)
    select sale_id_z, concat('q:', borough, ':', cast((year(d) - 1996) * 4 + quarter(d) - 1 as varchar)) as key, cast(sum(v) as double) as value from e where (year(d) - 1996) * 4 + quarter(d) - 1 <> 0 group by 1, 2""")
def m02(t):
    return estimation.long_design(t.pairs, "sale_id_z", estimation.calendar("borough", base_year=1996))


@query("m03_control_differences", "select sale_id_z, financed_strict_z - financed_strict_a as strict, financed_wide_z - financed_wide_a as wide from pairs")
def m03(t):
    d = estimation.control_differences(["financed_strict", "financed_wide"])
    return t.pairs.select("sale_id_z", d["financed_strict"].alias("strict"), d["financed_wide"].alias("wide"))


@query("m01_gram_sums", """with e as (select sale_id_z, concat('q:', borough, ':', cast((year(d) - 2016) * 4 + quarter(d) - 1 as varchar)) as k, v from
      (select sale_id_z, borough, date_a as d, -1.0 as v from pairs union all select sale_id_z, borough, date_z, 1.0 from pairs) union all select sale_id_z, 't:cf', cf from enriched union all select sale_id_z, 't:fc', fc from enriched union all select sale_id_z, 'y', y from enriched)
    select a.k as i, b.k as j, round(sum(cast(a.v as double) * b.v), 6) as s from e a join e b on a.sale_id_z = b.sale_id_z and a.k <= b.k group by 1, 2""")
def m01(t):
    return rounded(estimation.gram(t.enriched, estimation.contrast_entries("borough")))
