"""Queries of the joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tenure.functions import measures
from tenure.operators import linkage, parties, sampling

from .registry import query, rounded

GAP = "date_diff('day', s.sale_date, f.doc_date)"


@query("j01_interval_existence", "select sale_id, financed_strict, financed_base, financed_wide from flagged")
def j01(t):
    return t.flagged.select("sale_id", "financed_strict", "financed_base", "financed_wide")


@query("j02_largest_amount", "select sale_id, round(mort_amt, 6) as mort_amt from flagged")
def j02(t):
    return rounded(t.flagged.select("sale_id", "mort_amt"))


@query("j03_nearest_unique", f"""with h as (select s.sale_id, f.doc_id, abs({GAP}) as g from sales s join filings f on f.bbl = s.bbl and abs({GAP}) <= 45),
    m as (select sale_id, min(g) as g from h group by 1), n as (select h.sale_id, m.g, count(distinct doc_id) as ties, min(doc_id) as doc_id from h join m on m.sale_id = h.sale_id and m.g = h.g group by 1, 2)
    select s.sale_id, case when ties = 1 then doc_id end as doc_id, cast(g as integer) as nearest_gap, coalesce(ties, 0) as nearest_ties from sales s left join n on n.sale_id = s.sale_id""")
def j03(t):
    return linkage.nearest_unique(t.sales, t.filings)


@query("j04_unique_lot", f"""with f as (select doc_id, cast(length(bbl) as varchar) as block, doc_date, amount, bbl as lot, substr(bbl, 1, 2) as area from filings),
    x as (select s.sale_id, count(distinct case when abs(amount - price) <= 0.005 * price then lot end) as n, min(case when abs(amount - price) <= 0.005 * price then lot end) as lot, count(f.doc_date) as dated
        from sales s left join f on f.block = cast(length(s.bbl) as varchar) and f.area = substr(s.bbl, 1, 2) and abs({GAP}) <= 10 group by 1)
    select sale_id, case when n = 1 then lot end as lot, case when n = 1 then 'matched' when n > 1 then 'ambiguous' when dated > 0 then 'no amount' else 'no date' end as reason from x""")
def j04(t):
    area = {"block": F.length("bbl").cast("string"), "area": F.substring("bbl", 1, 2)}
    docs = t.filings.withColumns({**area, "lot": F.col("bbl")})
    return linkage.unique_match(t.sales.withColumns(area), docs, keys=["block", "area"], target="lot", within=10)


@query("j05_unique_document", f"""with x as (select s.sale_id, count(distinct case when abs(amount - price) <= 0.05 * price then doc_id end) as n, min(case when abs(amount - price) <= 0.05 * price then doc_id end) as doc_id, count(f.doc_date) as dated
    from sales s left join filings f on f.bbl = s.bbl and abs({GAP}) <= 45 group by 1)
    select sale_id, case when n = 1 then doc_id end as doc_id, case when n = 1 then 'matched' when n > 1 then 'ambiguous' when dated > 0 then 'no amount' else 'no date' end as reason from x""")
def j05(t):
    return linkage.unique_match(t.sales, t.filings, keys=["bbl"], share=0.05)


@query("j06_as_of", """select sale_id, round(rate, 6) as rate from sales s asof left join rates r on s.sale_date >= r.observed""")
def j06(t):
    return linkage.as_of(t.sales, t.rates, "sale_date", "observed", "rate").select("sale_id", F.round("rate", 6).alias("rate"))


@query("j07_lagged_month", """with m as (select borough, cast(date_trunc('month', sale_date) as date) as month, count(*) as n from sales group by 1, 2)
    select sale_id, n from sales s left join m on m.borough = s.borough and m.month = cast(date_trunc('month', sale_date) - interval 1 month as date)""")
def j07(t):
    m = t.sales.groupBy("borough", F.trunc("sale_date", "MM").alias("month")).agg(F.count("*").alias("n"))
    rows = t.sales.withColumn("month", measures.previous_month(F.col("sale_date")))
    return rows.join(m, ["borough", "month"], "left").select("sale_id", "n")


@query("j08_permit_between", """select sale_id_z, exists (select 1 from permits q where q.bbl = p.bbl and issued between date_a and date_z) as has_permit from pairs p""")
def j08(t):
    return linkage.flag_between(t.pairs, t.permits, "bbl", "date_a", "date_z", "issued", "has_permit").select("sale_id_z", "has_permit")


@query("j08_permit_free", """select sale_id_z from pairs p where not exists (select 1 from permits q where q.bbl = p.bbl and issued between date_a and date_z)""")
def j08_free(t):
    return linkage.exists_between(t.pairs, t.permits, "bbl", "date_a", "date_z", "issued", negate=True).select("sale_id_z")


@query("j09_single_parcel", """with l as (select cast(l_orderkey as varchar) as document_id, l_returnflag as bbl from lineitem)
    select document_id, min(bbl) as bbl from l group by 1 having count(distinct bbl) = 1""")
def j09(t):
    lots = t.lineitem.select(F.col("l_orderkey").cast("string").alias("document_id"), F.col("l_returnflag").alias("bbl"))
    return linkage.single_parcel(lots.select("document_id").distinct(), lots).select("document_id", "bbl")


@query("j10_dimension_default", """select o_orderkey, coalesce(n_name, '') as n_name from orders left join (select * from nation where n_nationkey < 12) on n_nationkey = o_custkey % 25""")
def j10(t):
    rows = t.orders.withColumn("n_nationkey", (F.col("o_custkey") % 25).cast(t.nation.schema["n_nationkey"].dataType))
    return linkage.lookup(rows, t.nation.where("n_nationkey < 12").select("n_nationkey", "n_name"), "n_nationkey", {"n_name": ""}).select("o_orderkey", "n_name")


@query("j11_one_to_one", "select o_orderkey, c_name from orders left join customer on c_custkey = o_custkey")
def j11(t):
    names = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return linkage.join_one(t.orders.select("o_orderkey", "o_custkey"), names, ["o_custkey"]).select("o_orderkey", "c_name")


@query("j12_endpoint_flags", """with d as (select cast(sale_id as varchar) as doc, price > 250000 as high from sales where sale_id % 3 = 0)
    select sale_id_z, coalesce(a.high, false) as high_a, coalesce(z.high, false) as high_z from pairs left join d a on a.doc = cast(sale_id_a as varchar) left join d z on z.doc = cast(sale_id_z as varchar)""")
def j12(t):
    flags = t.sales.where("sale_id % 3 = 0").select(F.col("sale_id").cast("string").alias("doc"), (F.col("price") > 250_000).alias("high"))
    rows = t.pairs.select("sale_id_z", F.col("sale_id_a").cast("string").alias("doc_a"), F.col("sale_id_z").cast("string").alias("doc_z"))
    return linkage.endpoint_flags(rows, flags, "doc", ["high"]).select("sale_id_z", "high_a", "high_z")


@query("j13_mutual_uniqueness", f"""with h as (select s.sale_id, f.doc_id from sales s join filings f on f.bbl = s.bbl and {GAP} between -15 and 90), c as (select doc_id, count(*) as claims from h group by 1),
    x as (select h.sale_id, count(*) as n, max(claims) as claims, min(h.doc_id) as doc_id from h join c on c.doc_id = h.doc_id group by 1)
    select s.sale_id, coalesce(n, 0) as candidates, case when n = 1 then claims end as competing, case when n = 1 then doc_id end as doc_id,
    cast(case when n is null then 0 when n = 1 and claims = 1 then 1 else -1 end as integer) as label from sales s left join x on x.sale_id = s.sale_id where price > 100000""")
def j13(t):
    return linkage.mutual_unique(t.sales, t.filings, -15, 90, eligible=F.col("price") > 100_000)


@query("j14_count_rule", f"""with k as (select sale_id, bbl, sale_date, price,
    count(*) over (partition by bbl order by sale_date range between interval 45 day preceding and interval 45 day following) as all_k,
    count(case when price > 100000 then 1 end) over (partition by bbl order by sale_date range between interval 45 day preceding and interval 45 day following) as k from sales),
    m as (select s.sale_id, s.k, s.all_k, count(f.doc_id) as m from k s left join filings f on f.bbl = s.bbl and {GAP} between -60 and 135 where price > 100000 group by 1, 2, 3)
    select sale_id, k, all_k, m, cast(case when m = 0 then 0 when m >= k then 1 else -1 end as integer) as legacy, cast(case when m = 0 then 0 when m >= all_k then 1 else -1 end as integer) as all_competitors from m""")
def j14(t):
    return linkage.count_rule(t.sales, t.filings, eligible=F.col("price") > 100_000)


@query("j15_anti_join", "select sale_id from sales s where not exists (select 1 from filings f where f.bbl = s.bbl and f.doc_date = s.sale_date)")
def j15(t):
    days = t.filings.select("bbl", F.col("doc_date").alias("sale_date"))
    return t.sales.join(days, ["bbl", "sale_date"], "left_anti").select("sale_id")


@query("j16_alignment", """select count(*) as rows, count(case when a.price = b.price then 1 end) as equal from sales a join flagged b on b.sale_id = a.sale_id""")
def j16(t):
    b = t.flagged.select("sale_id", F.col("price").alias("other"))
    return t.sales.join(b, "sale_id").agg(F.count("*").alias("rows"), F.count(F.when(F.col("price") == F.col("other"), 1)).alias("equal"))


@query("j17_adjacency", "select sale_id_a, sale_id_z, date_a, date_z from pairs")
def j17(t):
    return t.pairs.select("sale_id_a", "sale_id_z", "date_a", "date_z")


@query("j18_first_hit", f"""with h as (select s.sale_id, f.doc_id, f.doc_date, row_number() over (partition by s.sale_id order by f.doc_date, f.doc_id) as r from sales s join filings f on f.bbl = s.bbl and {GAP} between -30 and 120 and f.doc_type = 'R')
    select g.sale_id, h.doc_id, h.doc_date, cast(case when h.doc_id is not null then 1 else financed_strict end as integer) as relabelled from flagged g left join h on h.sale_id = g.sale_id and r = 1""")
def j18(t):
    hit = linkage.first_hit(t.sales, t.filings.where("doc_type = 'R'"), -30, 120)
    rows = t.flagged.select("sale_id", "financed_strict").join(hit, "sale_id", "left")
    label = measures.relabelled(F.col("financed_strict"), F.col("doc_id").isNotNull(), 1)
    return rows.select("sale_id", "doc_id", "doc_date", label.alias("relabelled"))


@query("j19_locate_all", """with c as (select bbl, date_a, date_z, count(*) as rows from pairs group by 1, 2, 3) select p.bbl, p.date_a, p.date_z, c.rows from pairs p join c on c.bbl = p.bbl and c.date_a = p.date_a and c.date_z = p.date_z""")
def j19_all(t):
    """Every pair as a case."""
    keys = ["bbl", "date_a", "date_z"]
    return linkage.locate(t.pairs, t.pairs.select(*keys), keys)


@query("j20_scenarios", """select h, f, round(h * n, 6) as recoded from (select cast(unnest([0.0, 0.08, 0.188]) as double) as h), (select cast(unnest([0.0, 0.036, 0.064]) as double) as f), (select cast(count(*) as double) as n from enriched)""")
def j20(t):
    grid = t.spark.createDataFrame([(h, f) for h in (0.0, 0.08, 0.188) for f in (0.0, 0.036, 0.064)], "h double, f double")
    n = t.enriched.agg(F.count("*").cast("double").alias("n"))
    return rounded(grid.crossJoin(F.broadcast(n)).select("h", "f", (F.col("h") * F.col("n")).alias("recoded")))


@query("j21_shared_ends_all", """with p as (select sale_id_z as id, year(date_a) * 4 + quarter(date_a) as a, year(date_z) * 4 + quarter(date_z) as z, bbl from pairs),
    c as (select bbl, a, z, count(*) as n from p group by 1, 2, 3), e as (select a, z, sum(n) as n from c group by 1, 2),
    t as (select e.a, e.z, sum(f.n) as n from e join e f on e.a in (f.a, f.z) or e.z in (f.a, f.z) group by 1, 2),
    w as (select c.bbl, c.a, c.z, coalesce(sum(d.n) filter (not (c.a in (d.a, d.z) or c.z in (d.a, d.z))), 0) as n from c join c d on d.bbl = c.bbl group by 1, 2, 3)
    select p.id, cast(t.n + w.n as bigint) as sharing from p join t on t.a = p.a and t.z = p.z join w on w.bbl = p.bbl and w.a = p.a and w.z = p.z""")
def j21_all(t):
    """All pairs; the SQL compares cells of quarters, and pairs of one parcel, not all pairs."""
    return _sharing(t.pairs)


def _sharing(pairs):
    from tenure.functions.measures import quarter_index

    p = pairs.select(F.col("sale_id_z").alias("id"), quarter_index(F.col("date_a")).alias("a"), quarter_index(F.col("date_z")).alias("z"), "bbl")
    return linkage.shared_ends(p, "bbl", "a", "z").select("id", "sharing")


@query("j22_reconcile", """with q as (select sale_id as case_id, bbl from sales where sale_id % 5 = 0), r as (select sale_id as case_id, case when sale_id % 35 = 0 then 'x' else bbl end as bbl from sales where sale_id % 15 <> 0 and sale_id % 7 = 0 or sale_id % 5 = 0 and sale_id % 15 <> 0)
    select case_id, problem from (select coalesce(q.case_id, r.case_id) as case_id, case when r.case_id is null then 'missing' when q.case_id is null then 'unknown' when q.bbl <> r.bbl then 'changed' end as problem
    from q full outer join r on q.case_id = r.case_id) where problem is not null""")
def j22(t):
    s, id_ = t.sales, F.col("sale_id")
    q = s.where(id_ % 5 == 0).select(id_.alias("case_id"), "bbl")
    r = s.where(((id_ % 15 != 0) & (id_ % 7 == 0)) | ((id_ % 5 == 0) & (id_ % 15 != 0)))
    r = r.select(id_.alias("case_id"), F.when(id_ % 35 == 0, "x").otherwise(F.col("bbl")).alias("bbl"))
    return linkage.reconcile(q, r, ["case_id"], ["bbl"])


@query("j22_override", """select sale_id, case when sale_id % 10 = 0 then 'edited' else src end as src, case when sale_id % 15 = 0 then '9' else borough end as borough from sales""")
def j22_override(t):
    s, id_ = t.sales, F.col("sale_id")
    edit = lambda m, f, v: s.where(id_ % m == 0).select("sale_id", F.lit(f).alias("field"), F.lit(v).alias("value"))
    edits = edit(10, "src", "edited").unionByName(edit(15, "borough", "9"))
    return linkage.override(s, edits, ["sale_id"], ["src", "borough"]).select("sale_id", "src", "borough")


@query("q01_switch_contrast", """select round((avg(case when cf = 1 then y end) - avg(case when fc = 1 then y end)) / 2, 6) as half_difference, round(avg(case when cf = 1 then y end) + avg(case when fc = 1 then y end), 6) as asymmetry,
    count(case when cf = 1 then 1 end) as cf, count(case when fc = 1 then 1 end) as fc from enriched""")
def q01(t):
    from tenure.operators.summary import half_difference

    return rounded(half_difference(t.enriched, "arm", "y").drop("z"))


@query("q02_coop_labels", f"""with h as (select s.sale_id, f.doc_id from sales s join filings f on f.bbl = s.bbl and {GAP} between -15 and 30), c as (select doc_id, count(*) as claims from h group by 1),
    x as (select h.sale_id, count(*) as n, max(claims) as claims from h join c on c.doc_id = h.doc_id group by 1), l as (select s.*, case when n is null then 0 when n = 1 and claims = 1 then 1 else -1 end as label from sales s left join x on x.sale_id = s.sale_id),
    p as (select lag(label) over w as a, label as z, lag(sale_date) over w as d, sale_date, bbl from l window w as (partition by bbl order by sale_date, sale_id))
    select cast(a as integer) as label_a, cast(z as integer) as label_z, count(*) as pairs from p where date_diff('day', d, sale_date) >= 180 and a >= 0 and z >= 0 group by 1, 2""")
def q02(t):
    """Uniqueness labels, pairing over all sales, ambiguous ends dropped after pairing."""
    from tenure.operators.pairing import consecutive

    labels = linkage.mutual_unique(t.sales, t.filings, -15, 30).select("sale_id", "label")
    rows = t.sales.join(labels, "sale_id")
    p = consecutive(rows, "bbl", ["sale_date", "sale_id"], carry=["label", "sale_date"], day="sale_date", hold=180)
    return p.where("label_a >= 0 and label_z >= 0").groupBy("label_a", "label_z").agg(F.count("*").alias("pairs"))


@query("q03_related_parties", r"""with n as (select document_id, party_type, case when not regexp_matches(upper(trim(name)), '\b(LLC|CORP|TRUST|BANK|HOLDINGS|ASSOCIATION)\b') and contains(name, ',')
    and length(trim(split_part(upper(trim(name)), ',', 1))) > 1 then trim(split_part(upper(trim(name)), ',', 1)) end as s from parties),
    f as (select s from (select distinct * from n where s is not null) group by 1 order by count(*) desc, s limit 10),
    b as (select distinct a.document_id, a.s from n a join n b on a.document_id = b.document_id and a.s = b.s and a.party_type = '1' and b.party_type = '2')
    select document_id, document_id in (select document_id from b) as related, document_id in (select document_id from b where s not in (select s from f)) as related_strict from (select distinct document_id from parties)""")
def q03(t):
    return parties.related(t.parties, common=10)


@query("q04_blinded_sample", """select sale_id, case_id, n from (select sale_id, printf('H%03d', row_number() over (order by md5(concat('3:', cast(sale_id as varchar))), sale_id)) as case_id, count(*) over () as n
    from (select sale_id, row_number() over (partition by src order by md5(concat('2:', cast(sale_id as varchar))), sale_id) as r from sales) where r <= 4)""")
def q04(t):
    s = sampling.stratified(t.sales, "sale_id", ["src"], 4, 2)
    _, key = sampling.blinded(s, "sale_id", 3, ["src"])
    return key.crossJoin(F.broadcast(s.agg(F.count("*").alias("n")))).select("sale_id", "case_id", "n")
