"""Queries of the window functions, sorts, sets and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from tenure.operators import pairing, resampling, sampling

from .registry import query, rounded


@query("w01_sale_number", "select sale_id, cast(row_number() over (partition by bbl order by sale_date, sale_id) as integer) as n_sale from sales")
def w01(t):
    return pairing.numbered(t.sales, "bbl", ["sale_date", "sale_id"]).select("sale_id", "n_sale")


@query("w02_parcel_size", "select sale_id, count(*) over (partition by bbl) as n_sales_total from sales")
def w02(t):
    return pairing.numbered(t.sales, "bbl", ["sale_date", "sale_id"]).select("sale_id", "n_sales_total")


PAIRED = """select * from (select bbl, lag(sale_id) over w as a, sale_id as z, date_diff('day', lag(sale_date) over w, sale_date) as days from {} window w as (partition by bbl order by sale_date, sale_id)) where days >= {}"""


@query("w03_consecutive_pairs", f"select a, z from ({PAIRED.format('sales', 365)})")
def w03(t):
    p = pairing.consecutive(t.sales, "bbl", ["sale_date", "sale_id"], carry=["sale_id", "sale_date"], day="sale_date", hold=365)
    return p.select(F.col("sale_id_a").alias("a"), F.col("sale_id_z").alias("z"))


@query("w04_filter_order", f"""with dropped as (select * from sales where price > 100000), one as ({PAIRED.format('dropped', 180)}), two as (select p.* from ({PAIRED.format('sales', 180)}) p join dropped x on x.sale_id = p.a join dropped y on y.sale_id = p.z)
    select (select count(*) from one) as drop_then_pair, (select count(*) from two) as pair_then_drop, (select count(*) from one where not exists (select 1 from two where two.a = one.a and two.z = one.z)) as bridged""")
def w04(t):
    pair = lambda rows: pairing.consecutive(
        rows, "bbl", ["sale_date", "sale_id"], carry=["sale_id", "sale_date", "price"], day="sale_date", hold=180
    )
    one = pair(t.sales.where("price > 100000")).select("sale_id_a", "sale_id_z")
    two = pair(t.sales).where("price_a > 100000 and price_z > 100000").select("sale_id_a", "sale_id_z", F.lit(1).alias("two"))
    both = one.withColumn("one", F.lit(1)).join(two, ["sale_id_a", "sale_id_z"], "full_outer")
    return both.agg(F.count("one").alias("drop_then_pair"), F.count("two").alias("pair_then_drop"), F.count(F.when(F.col("two").isNull(), 1)).alias("bridged"))


@query("w05_flip_filter", """select sale_id from (select sale_id, date_diff('day', lag(sale_date) over (partition by bbl order by sale_date, sale_id), sale_date) as g from sales) where g is null or g >= 180""")
def w05(t):
    return pairing.drop_flips(t.sales, "bbl", ["sale_date", "sale_id"], "sale_date", 180).select("sale_id")


@query("w06_rolling_count", "select sale_id, count(*) over (partition by bbl order by sale_date range between interval 45 day preceding and interval 45 day following) as near from sales")
def w06(t):
    return pairing.rolling_count(t.sales, "bbl", "sale_date", 45, "near").select("sale_id", "near")


@query("w07_weighted_cdf", """select sale_id_z, round((sum(w) over (partition by borough order by y rows unbounded preceding) - w / 2) / sum(w) over (partition by borough), 6) as cdf
    from (select sale_id_z, borough, y, cast(1 + sale_id_z % 3 as double) as w from enriched)""")
def w07(t):
    rows = t.enriched.withColumn("w", (1 + F.col("sale_id_z") % 3).cast("double"))
    return rounded(pairing.weighted_cdf(rows, "y", "w", ["borough"]).select("sale_id_z", "cdf"))


@query("w08_long_gaps_all", """with d as (select distinct borough, zipcode, sale_date from sales) select borough, zipcode, sale_date, next, cast(date_diff('day', sale_date, next) as integer) as days
    from (select *, lead(sale_date) over (partition by borough, zipcode order by sale_date) as next from d) where date_diff('day', sale_date, next) > 8""")
def w08_all(t):
    """The gaps of every borough and ZIP code."""
    return pairing.gaps(t.sales, "sale_date", 8, ["borough", "zipcode"])


@query("w09_dense_codes", "select sale_id, dense_rank() over (order by bbl) - 1 as code from sales")
def w09(t):
    return pairing.dense_codes(t.sales, "bbl", "code").select("sale_id", "code")


@query("w10_two_sale_switchers", """select sale_id from (select *, count(*) over (partition by bbl, year(sale_date)) as n, lag(financed_strict) over (partition by bbl, year(sale_date) order by sale_date, sale_id) as a from flagged) where n = 2 and a <> financed_strict""")
def w10(t):
    rows = t.flagged.withColumn("k", F.concat_ws("|", "bbl", F.year("sale_date").cast("string")))
    return pairing.two_sale_switchers(rows, "k", ["sale_date", "sale_id"], "financed_strict").select("sale_id")


@query("w11_first_per_key", "select bbl, sale_id from (select *, row_number() over (partition by bbl order by price desc, sale_id) as r from sales) where r = 1")
def w11(t):
    return pairing.first_per(t.sales, ["bbl"], [F.desc("price"), F.col("sale_id")]).select("bbl", "sale_id")


@query("w12_demeaned", "select sale_id_z, round(y - avg(y) over (partition by borough), 6) as y_within from enriched")
def w12(t):
    return rounded(pairing.demeaned(t.enriched, ["y"], "borough").select("sale_id_z", "y_within"))


@query("w13_hold_sweep", """select cast(h as integer) as hold, count(*) as n, round(avg(y), 6) as mean from (select *, date_diff('day', date_a, date_z) as days from enriched), (select unnest([180, 365, 730]) as h) where days >= h group by 1""")
def w13(t):
    rows = t.enriched.withColumn("days", F.datediff("date_z", "date_a"))
    return rounded(pairing.hold_sweep(rows, "days", [180, 365, 730], F.count("*").alias("n"), F.avg("y").alias("mean")))


@query("o01_most_influential", "select sale_id_z, round(y, 6) as y from enriched order by abs(enriched.y) desc, sale_id_z limit 60")
def o01(t):
    return rounded(t.enriched.orderBy(F.desc(F.abs("y")), "sale_id_z").limit(60).select("sale_id_z", "y"))


@query("o02_top_zips", "select zipcode, count(*) as n from pairs group by 1 order by count(*) desc, zipcode limit 3")
def o02(t):
    return t.pairs.groupBy("zipcode").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "zipcode").limit(3)


@query("o03_sorted", "select bbl, sale_date, sale_id from sales")
def o03(t):
    return t.sales.select("bbl", "sale_date", "sale_id").orderBy("bbl", "sale_date", "sale_id")


SIGN = "(case when {0} = 0 and {1} = 1 then 1 when {0} = 1 and {1} = 0 then -1 else 0 end)"
EFFECTS = f"""select sale_id_z, e as "end", cast(case when e = 'a' then financed_base_a else financed_base_z end as integer) as label,
    y * ({SIGN.format('financed_base_a', 'financed_base_z')} - case when e = 'a' then {SIGN.format('(1 - financed_base_a)', 'financed_base_z')} else {SIGN.format('financed_base_a', '(1 - financed_base_z)')} end) as effect
    from enriched, (select unnest(['a', 'z']) as e)"""


@query("m28_recoding_candidates", f'select sale_id_z, "end", label, round(effect, 6) as effect from ({EFFECTS})')
def m28(t):
    return rounded(resampling.candidates(t.enriched, "sale_id_z", "y"))


@query("o04_adversarial", f"""select sale_id_z, round(effect, 6) as effect from (select sale_id_z, max(effect) as effect from ({EFFECTS}) group by 1) x order by x.effect desc, sale_id_z limit 50""")
def o04(t):
    rows = resampling.adversarial(resampling.candidates(t.enriched, "sale_id_z", "y"), "sale_id_z", 50)
    return rounded(rows.select("sale_id_z", "effect"))


@query("u01_union_all", "select sale_id_a as sale_id, 'a' as side from pairs union all select sale_id_z, 'z' from pairs")
def u01(t):
    side = lambda s: t.pairs.select(F.col(f"sale_id_{s}").alias("sale_id"), F.lit(s).alias("side"))
    return side("a").unionByName(side("z"))


@query("u02_union", "select bbl, date_a as day from pairs union select bbl, date_z from pairs")
def u02(t):
    side = lambda d: t.pairs.select("bbl", F.col(d).alias("day"))
    return side("date_a").union(side("date_z")).dropDuplicates()


@query("u03_union_filled", "select sale_id, price, zipcode, null::varchar as unit from sales where src = 'BUILDING' union all select sale_id, price, null, bbl from sales where src = 'MACHINERY'")
def u03(t):
    a = t.sales.where("src = 'BUILDING'").select("sale_id", "price", "zipcode")
    b = t.sales.where("src = 'MACHINERY'").select("sale_id", "price", F.col("bbl").alias("unit"))
    return a.unionByName(b, allowMissingColumns=True)


@query("u04_shared_names", """select document_id, len(list_intersect(list(distinct name) filter (where party_type = '1'), list(distinct name) filter (where party_type = '2'))) > 0 as shared from parties group by 1""")
def u04(t):
    side = lambda r: F.collect_set(F.when(F.col("party_type") == r, F.col("name")))
    sets = t.parties.groupBy("document_id").agg(side("1").alias("s"), side("2").alias("b"))
    return sets.select("document_id", F.arrays_overlap("s", "b").alias("shared"))


@query("u05_except", "select bbl from sales except select bbl from permits")
def u05(t):
    return t.sales.select("bbl").distinct().join(t.permits.select("bbl"), "bbl", "left_anti")


@query("u06_distinct_ids", "select sale_id_a as sale_id from pairs union select sale_id_z from pairs")
def u06(t):
    return t.pairs.select(F.col("sale_id_a").alias("sale_id")).union(t.pairs.select("sale_id_z")).distinct()


STRATIFIED = """select *, count(*) over (partition by src) as stratum_population, row_number() over (partition by src order by md5(concat('7:', cast(sale_id as varchar))), sale_id) as r from sales"""


@query("r01_stratified_sample", f"select sale_id, src, stratum_population, round(least(30, stratum_population) / stratum_population, 6) as probability from ({STRATIFIED}) where r <= 30")
def r01(t):
    return rounded(sampling.stratified(t.sales, "sale_id", ["src"], 30, 7).select("sale_id", "src", "stratum_population", "probability"))


@query("r02_targeted_additions", f"""with s as (select sale_id from ({STRATIFIED}) where r <= 20), x as (select sale_id from sales order by price desc, sale_id limit 40)
    select sale_id, 'random' as sample_kind from s union all select sale_id, 'targeted' from x where sale_id not in (select sale_id from s)""")
def r02(t):
    s = sampling.stratified(t.sales, "sale_id", ["src"], 20, 7).select("sale_id")
    return sampling.additions(s, t.sales.orderBy(F.desc("price"), "sale_id").limit(40).select("sale_id"), "sale_id")


@query("r03_blinded_ids", f"select sale_id, printf('H%03d', cast(row_number() over (order by md5(concat('9:', cast(sale_id as varchar))), sale_id) as integer)) as case_id from ({STRATIFIED}) where r <= 20")
def r03(t):
    sheet, _ = sampling.blinded(sampling.stratified(t.sales, "sale_id", ["src"], 20, 7), "sale_id", 9, ["src"])
    return sheet.select("sale_id", "case_id")


@query("r04_weighted_sample", """select sale_id, round(ln((('0x' || substr(md5(concat('4:', cast(sale_id as varchar))), 1, 12))::bigint + 0.5) / 281474976710656.0) / price, 12) as draw_key from sales order by ln((('0x' || substr(md5(concat('4:', cast(sale_id as varchar))), 1, 12))::bigint + 0.5) / 281474976710656.0) / price desc, sale_id limit 100""")
def r04(t):
    return rounded(sampling.weighted_without_replacement(t.sales, "sale_id", F.col("price"), 100, 4).select("sale_id", "draw_key"), 12)
