"""Queries that write and read back: delimited text, JSON, maps, dated text, wide tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tenure.operators import resampling
from tenure.operators.scan import scanned
from tenure.operators.tables import scratch
from tenure.sources import files, paged, sinks

from .registry import query, rounded


@query("s01_k01_gzip_csv", "select sale_id, bbl, sale_date, price, borough from sales where borough <> '4'")
def s01(t):
    path = scratch(t.spark, "csv")
    sinks.write_csv(t.sales.select("sale_id", "bbl", "sale_date", "price", "borough"), path, order=["bbl", "sale_date"])
    return files.read_csv(t.spark, path, "sale_id long, bbl string, sale_date date, price double, borough string").where("borough <> '4'")


@query("s02_typed_csv", "select cast(c_custkey as varchar) as id, lpad(cast(c_nationkey as varchar), 5, '0') as zip from customer")
def s02(t):
    path = scratch(t.spark, "csv")
    rows = t.customer.select(F.col("c_custkey").cast("string").alias("id"), F.lpad(F.col("c_nationkey").cast("string"), 5, "0").alias("zip"))
    sinks.write_csv(rows, path, gzip=False)
    return files.read_csv(t.spark, path, "id string, zip string", partitions=4)


@query("s03_s04_json_array", "select cast(n_nationkey as bigint) as k, n_name as name from nation")
def s03(t):
    path = scratch(t.spark, "json")
    whole = t.nation.select(F.struct(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("name")).alias("r"))
    whole.agg(F.to_json(F.collect_list("r")).alias("value")).write.option("compression", "gzip").text(path)  # 25 rows
    return files.read_json_array(t.spark, path, "k long, name string")


@query("s05_map_of_arrays", "select bbl, doc_date, doc_id as document_id from filings where doc_type = 'R'")
def s05(t):
    pair = F.array(F.col("doc_date").cast("string"), "doc_id")
    maps = t.filings.where("doc_type = 'R'").groupBy("bbl").agg(F.collect_list(pair).alias("p"))
    return files.flatten_map(maps.select(F.to_json(F.create_map("bbl", "p")).alias("j")), "j")


@query("s06_rate_text", "select observed, round(rate, 2) as rate, true as consistent from rates")
def s06(t):
    n = F.unix_date("observed") * 10
    day = t.rates.select(n.alias("line_no"), F.date_format("observed", "MMMM d, yyyy").alias("line"))
    rate = t.rates.select((n + 1).alias("line_no"), F.concat(F.lit("Average Rates | "), F.format_number("rate", 2), F.lit("%")).alias("line"))
    lost = t.rates.select((n + 4).alias("line_no"), F.lit("Average Rates | 99.00%").alias("line"))
    return files.parse_rates(day.union(rate).union(lost))


@query("s07_wide_months", """select borough, cast(date_trunc('month', sale_date) as date) as month, count(*) as level from sales where sale_date >= date '1996-01-01' and sale_date < date '1997-01-01' group by 1, 2""")
def s07(t):
    months = [f"{y}-{m:02d}" for y in (1995, 1996) for m in range(1, 13)]
    monthly = t.sales.withColumn("m", F.date_format("sale_date", "yyyy-MM")).groupBy("borough")
    wide = monthly.pivot("m", months).count()
    return files.unpivot_months(wide, ["borough"], "1996-01", "1996-12")


@query("s15_k02_ndjson", "select bbl, sale_id, price from sales")
def s15(t):
    path = scratch(t.spark, "ndjson")
    sinks.write_json(t.sales.select("bbl", "sale_id", "price"), path)
    return files.read_ndjson(t.spark, path, "bbl string, sale_id long, price double")


@query("k03_draws", "select borough, round(sum(y), 6) as influence from enriched group by 1")
def k03(t):
    path = scratch(t.spark, "draws")
    sinks.write_draws(t.enriched.groupBy("borough").agg(F.sum("y").alias("influence")), path)
    return rounded(t.spark.read.parquet(path))


@query("k09_queue_update", "select sale_id, case when sale_id % 9 = 0 then 'seen' else src end as src from sales")
def k09(t):
    evidence = t.sales.where("sale_id % 9 = 0").select("sale_id", F.lit("seen").alias("src"))
    return sinks.update_queue(t.sales.select("sale_id", "src"), evidence, "sale_id", ["src"])


PAGED = {"fetcher": "tenure.sources.paged:table_pages"}
CUSTOMERS = "k string, name string"
CUSTOMERS_SQL = "select cast(c_custkey as varchar) as k, c_name as name from customer"


def service(pages, path: str | None = None) -> str:
    """A folder of pages as a service would return them: rows with their ``page``, written by the executors on shelves."""
    path = path or scratch(pages.sparkSession, "pages")
    shelved = pages if "shelf" in pages.columns else pages.withColumn("shelf", F.col("page"))
    shelved.write.mode("overwrite").partitionBy("shelf").json(path)
    return path


def customers(t):
    return t.customer.select(F.col("c_custkey").cast("string").alias("k"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))


def offset_pages(t, size: int):
    """The customers in the order of their keys with the offset of their page."""
    rows = scanned(customers(t), [], [F.col("k").cast("long")], number="n")
    number = F.floor((F.col("n") - 1) / size)
    return rows.select("k", "name", (number * size).cast("string").alias("page"), F.floor(number / paged.SHELF).alias("shelf"))


@query("s08_cached_requests", CUSTOMERS_SQL)
def s08(t):
    """Pages from the cache: of a service that has only half its pages left nothing is asked that was read once."""
    pages = offset_pages(t, 100)
    path = service(pages)
    cache, n = scratch(t.spark, "cache"), t.customer.count()
    read = lambda: paged.read_offsets(t.spark, path, CUSTOMERS, n, 100, cache=cache, **PAGED)
    read()
    service(pages.where("cast(page as long) % 200 = 0"), path)
    return read()


@query("s09_id_batches", "select cast(n_nationkey as varchar) as k, n_name as name from nation")
def s09(t):
    """The ids are a list that the caller has."""
    nations = t.nation.select(F.col("n_nationkey").cast("string").alias("k"), F.col("n_name").alias("name"))
    ids = sorted(r.k for r in nations.select("k").collect())
    batch = F.format_string("ids-%05d", F.floor((F.array_position(F.lit(ids), F.col("k")) - 1) / 4))
    return paged.read_ids(t.spark, service(nations.withColumn("page", batch)), CUSTOMERS, ids, "k", 4, **PAGED)


@query("s10_counted_pages", CUSTOMERS_SQL)
def s10(t):
    return paged.read_offsets(t.spark, service(offset_pages(t, 70)), CUSTOMERS, t.customer.count(), 70, **PAGED)


@query("s11_key_ranges", CUSTOMERS_SQL)
def s11(t):
    """Disjoint ranges of a key that repeats: no page's edge cuts a key."""
    rows = customers(t).withColumn("nation", F.format_string("%02d", "nation"))
    ends = [f"{k:02d}" for k in range(4, 25, 5)]  # five nations a page
    ranges = list(zip(["", *ends], ends, strict=False))
    page = F.coalesce(*[F.when((F.col("nation") > a) & (F.col("nation") <= b), f"after-{a}") for a, b in ranges])
    return paged.read_ranges(t.spark, service(rows.select("k", "name", page.alias("page"))), CUSTOMERS, ranges, **PAGED)


@query("s12_until_short_page", CUSTOMERS_SQL)
def s12(t):
    return paged.read_until_short(t.spark, service(offset_pages(t, 50)), CUSTOMERS, 50, **PAGED)


@query("s13_verified_cache", CUSTOMERS_SQL)
def s13(t):
    """Entries whose rows don't fit their number, and those of another request, are asked for again."""
    path = service(offset_pages(t, 100))
    cache, damaged, n = scratch(t.spark, "cache"), scratch(t.spark, "cache"), t.customer.count()
    read = lambda cache: paged.read_offsets(t.spark, path, CUSTOMERS, n, 100, cache=cache, **PAGED)
    read(cache)
    held = t.spark.read.schema(paged.ENTRY).parquet(cache)
    cut, other = F.crc32("request") % 3 == 0, F.crc32("request") % 3 == 1
    held = held.withColumn("page", F.when(cut, F.slice("page", 1, F.col("n") - 1)).otherwise(F.col("page")))
    held.withColumn("request", F.when(other, F.concat(F.lit("another "), "request")).otherwise(F.col("request"))).write.parquet(damaged)
    return read(damaged)


@query("s14_remote_aggregates", "select cast(c_nationkey as varchar) as r, count(*) as n, max(c_name) as last from customer group by 1")
def s14(t):
    """Counts that a service computes for each filter it is asked: one a nation."""
    counts = customers(t).groupBy("nation").agg(F.count("*").alias("n"), F.max("name").alias("last"))
    nations = sorted(r.nation for r in counts.select("nation").collect())
    index = F.array_position(F.lit(nations), F.col("nation")) - 1
    path = service(counts.select("n", "last", F.format_string("where-%05d", index).alias("page")))
    read = paged.read_aggregates(t.spark, path, "r string, n string, last string", [{"r": str(k)} for k in nations], **PAGED)
    return read.withColumn("n", F.col("n").cast("long"))


@query("s18_review_sheet", """select cast(sale_id as varchar) as case_id, concat('says "', src, '", ', borough) as note, cast(null as varchar) as reading from sales""")
def s18(t):
    """A sheet of text columns by the names of its header, quotes and commas within."""
    path = scratch(t.spark, "sheet")
    note = F.concat(F.lit('says "'), "src", F.lit('", '), "borough").alias("note")
    sheet = t.sales.select(F.col("sale_id").cast("string").alias("case_id"), note, F.lit(None).cast("string").alias("reading"))
    sheet.write.option("header", True).option("escape", '"').csv(path)
    return t.spark.read.option("header", True).option("escape", '"').csv(path)


@query("k04_latex_table", r"""with r as (select n_regionkey as k, count(*) as n, -cast(sum(n_nationkey) as double) / 4 as v from nation group by 1)
    select concat(cast(k as varchar), ' & ', cast(n as varchar), ' & $-$', printf('%.2f', -v), ' \\') as line from r""")
def k04(t):
    rows = t.nation.groupBy("n_regionkey").agg(F.count("*").alias("n"), (-F.sum("n_nationkey").cast("double") / 4).alias("v"))
    text = sinks.latex_table([(str(r["n_regionkey"]), r["n"], r["v"]) for r in rows.collect()], ["region", "n", "v"])  # five regions
    return t.spark.createDataFrame([(x,) for x in text.split("\n")[4:-2]], "line string")


@query("k05_macros", r"""select concat('\newcommand{\', translate(r_name, ' ', ''), '}{', printf('%.2f', cast(r_regionkey as double)), '}') as line from region
    union all select concat('\newcommand{\sales}{', printf('{:,}', count(*)), '}') from sales""".replace("printf('{:,}', count(*))", "format('{:,}', count(*))"))
def k05(t):
    values = {r["r_name"]: float(r["r_regionkey"]) for r in t.region.collect()} | {"sales": t.sales.count()}  # five regions
    return t.spark.createDataFrame([(x,) for x in sinks.macros(values).split("\n")], "line string")


@query("k08_input_hashes", "select cast(n_nationkey as varchar) as k, cast(strlen(n_name) + 1 as bigint) as bytes, sha256(concat(n_name, chr(10))) as sha256 from nation")
def k08(t):
    """Size and hash of each file, as a run's manifest lists its inputs."""
    path = scratch(t.spark, "inputs")
    t.nation.select(F.col("n_nationkey").alias("k"), "n_name").repartition(1).write.partitionBy("k").text(path)
    hashed = sinks.file_hashes(t.spark, path).where("path like '%.txt'")
    return hashed.select(F.regexp_extract("path", r"/k=(\d+)/", 1).alias("k"), "bytes", "sha256")


@query("r05_cluster_weights", "select cast(d as integer) as draw, (select count(distinct bbl) from pairs) as clusters, (select count(distinct bbl) from pairs) as total from range(50) r(d)")
def r05(t):
    """Multinomial counts of the clusters: as many in every draw as there are clusters."""
    clusters = t.pairs.agg(F.count_distinct("bbl")).first()[0]
    return resampling.counted(resampling.multinomial_weights(t.spark, clusters, 50, 20260909))
