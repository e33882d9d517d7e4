"""The jobs: equal results on reruns, single years, growing input, and a batch that is cut short."""

import pytest
from pyspark.sql import functions as F

from jobs import evidence_register, repeat_sale_panel
from tenure.plans.registry import Tables

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(repr(tuple(r)) for r in df.collect())


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    out = f"file://{tmp_path_factory.mktemp('panel')}"
    return out, repeat_sale_panel.run(spark, SF, out, repeat_sale_panel.settings())


def test_panel_has_all_pairs_and_its_summary(spark, made):
    out, panel = made
    pairs = Tables(spark, SF).enriched
    assert rows(panel.select("sale_id_a", "sale_id_z", "arm", F.round("growth", 9))) == rows(pairs.select("sale_id_a", "sale_id_z", "arm", F.round("y", 9)))
    summary = spark.read.schema(repeat_sale_panel.SUMMARY).parquet(f"{out}/summary")
    assert summary.agg(F.sum("pairs")).first()[0] == panel.count() == summary.join(panel.select("borough", "year", "arm").distinct(), ["borough", "year", "arm"]).agg(F.sum("pairs")).first()[0]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{out}/panel").where("path like '%.parquet'")
    assert files.where("path like '%/borough=%/year=%'").count() == files.count() > 1


def test_panel_again_and_by_years(spark, made, tmp_path):
    out, panel = made
    before = rows(panel)
    again = repeat_sale_panel.run(spark, SF, out, repeat_sale_panel.settings())
    assert rows(again) == before
    years = sorted(r.year for r in again.select("year").distinct().collect())
    part = repeat_sale_panel.run(spark, SF, out, repeat_sale_panel.settings(), (years[1], years[2]))
    assert rows(part) == before
    summary = rows(spark.read.schema(repeat_sale_panel.SUMMARY).parquet(f"{out}/summary"))
    repeat_sale_panel.run(spark, SF, out, repeat_sale_panel.settings())
    assert rows(spark.read.schema(repeat_sale_panel.SUMMARY).parquet(f"{out}/summary")) == summary


def test_panel_settings_and_empty_tables(spark, tmp_path):
    config = repeat_sale_panel.settings() | {"hold_days": 720, "spread": None, "label": "wide"}
    panel = repeat_sale_panel.run(spark, SF, f"{tmp_path}/long", config)
    assert panel.where("datediff(date_z, date_a) < 720").isEmpty() and not panel.isEmpty()
    assert panel.where("arm <> concat(if(financed_wide_a = 1, 'f', 'c'), if(financed_wide_z = 1, 'f', 'c'))").isEmpty()
    for name in ("orders", "customer", "nation", "lineitem"):
        spark.read.parquet(f"{SF}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert repeat_sale_panel.run(spark, f"{tmp_path}/none", f"{tmp_path}/empty", repeat_sale_panel.settings()).count() == 0


def test_panel_meets_filings_by_spans_and_neighbours_without_a_join(spark):
    """Flags are those of all sales against all filings, though only days of a span meet; pairs by periods are pairs by keys."""
    import datetime as dt
    import random

    from tenure.operators import linkage, pairing

    rng, first = random.Random(4), dt.date(1969, 1, 1)
    day = lambda: first + dt.timedelta(rng.randrange(1500)) if rng.random() > 0.02 else None
    sales = [(i, rng.choice(["a", "b", None]), day()) for i in range(200)]
    filings = [(rng.choice(["a", "b", None]), day(), rng.choice([1.0, 2.5, None])) for _ in range(40)]
    s, f = spark.createDataFrame(sales, "sale_id int, bbl string, sale_date date"), spark.createDataFrame(filings, "bbl string, doc_date date, amount double")
    windows = {"x": (-15, 30), "y": (5, 90)}
    flagged = linkage.window_flags(s, f, windows, amount_in="y")
    joins = [line for line in flagged._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line]
    assert joins and all("__span" in line for line in joins)
    want = []
    for i, key, at in sales:
        gaps = [((d - at).days, a) for k, d, a in filings if key and k == key and at and d]
        inside = {n: [(g, a) for g, a in gaps if low <= g <= high] for n, (low, high) in windows.items()}
        want.append((i, int(bool(inside["x"])), int(bool(inside["y"])), max([a for _, a in inside["y"] if a], default=0.0)))
    assert sorted(tuple(r) for r in flagged.select("sale_id", "financed_x", "financed_y", "mort_amt").collect()) == want
    assert {r[1:3] for r in want} == {(0, 0), (0, 1), (1, 0), (1, 1)}
    made = [pairing.consecutive(flagged, "bbl", ["sale_date", "sale_id"], carry=["sale_id", "sale_date"], day="sale_date", hold=2, spread=p) for p in (None, "year", "month")]
    assert rows(made[0]) == rows(made[1]) == rows(made[2]) != []
    joined = [pairing.consecutive(s, "bbl", ["sale_date", "sale_id"], carry=["sale_id", "sale_date"], day="sale_date", hold=2, spread=p) for p in ("year", "month")]
    assert all("Join" not in m._jdf.queryExecution().optimizedPlan().toString() for m in joined)


DOCUMENTS = [
    (1, "Sold to ACME HOLDINGS LLC.", "a", "x"), (2, "Sold to ACME HOLDINGS LLC.", "b", "x"), (3, None, "a", "x"), (4, " \n", None, "x"),
    (5, "Mortgage of WELLS FARGO BANK", "a", "x"), (None, "no id", "a", "x"), (6, "NYS REAL ESTATE TRANSFER TAX $ 2,000.00", "a", "x"), (7, "plain", "b", "x"),
    (7, "plain", "b", "x"),
]
LATER = [(8, "plain", "a", "x"), (9, "new", "b", "x"), (0, "new", "b", "x"), (10, "Sold to ACME HOLDINGS LLC.", "c", "x")]
SCHEMA = "doc_id long, text string, source string, queue string"


def add(spark, rows_, path):
    spark.createDataFrame(rows_, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def entered(df):
    return sorted((r.batch, str(r.doc_id), str(r.first_id), r.queue) for r in df.collect())


FIRST = [(0, "1", "1", "party"), (0, "2", "1", "copy"), (0, "3", "None", "empty"), (0, "4", "None", "empty"), (0, "5", "5", "lender"), (0, "6", "6", "cover"),
         (0, "7", "7", "other"), (0, "7", "7", "other"), (0, "None", "None", "other")]
SECOND = [(1, "0", "0", "other"), (1, "10", "1", "copy"), (1, "8", "7", "copy"), (1, "9", "0", "copy")]


def register(spark, base):
    return evidence_register.run(spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint", evidence_register.settings())


def files(spark, base):
    own = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{base}/out/register")
    return {r.path: r.modificationTime for r in own.select("path", "modificationTime").collect()}


def test_register_takes_only_what_is_new(spark, tmp_path):
    add(spark, DOCUMENTS, f"{tmp_path}/in")
    assert entered(register(spark, tmp_path)) == FIRST
    before = files(spark, tmp_path)
    assert entered(register(spark, tmp_path)) == FIRST and files(spark, tmp_path) == before
    add(spark, LATER, f"{tmp_path}/in")
    done = register(spark, tmp_path)
    assert entered(done) == sorted(FIRST + SECOND)
    assert done.where("doc_id = 6").first().consideration == 500_000.0
    assert before.items() <= files(spark, tmp_path).items()  # the first batch wasn't touched
    totals = evidence_register.totals(spark, f"{tmp_path}/out")
    assert totals.agg(F.sum("documents")).first()[0] == len(DOCUMENTS) + len(LATER)


def test_a_batch_cut_short_is_taken_again(spark, tmp_path, monkeypatch):
    add(spark, DOCUMENTS, f"{tmp_path}/in")
    register(spark, tmp_path)
    add(spark, LATER, f"{tmp_path}/in")
    enter = evidence_register.enter

    def broken(*args):
        enter(*args)
        raise OSError("lost after the write, before the checkpoint")

    monkeypatch.setattr(evidence_register, "enter", broken)
    with pytest.raises(Exception, match="lost after the write"):
        register(spark, tmp_path)
    monkeypatch.undo()
    assert entered(register(spark, tmp_path)) == sorted(FIRST + SECOND)


def test_register_in_small_batches_equals_one(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.repartitionByRange(4, "doc_id").write.parquet(f"{tmp_path}/in")
    small = evidence_register.run(spark, f"{tmp_path}/in", f"{tmp_path}/a", f"{tmp_path}/ca", evidence_register.settings() | {"files_per_batch": 1})
    whole = evidence_register.run(spark, f"{tmp_path}/in", f"{tmp_path}/b", f"{tmp_path}/cb", evidence_register.settings())
    assert small.select("batch").distinct().count() == 4
    same_text = lambda df: rows(df.groupBy("text_sha256").agg(F.count("*"), F.count_if(F.col("queue") == "copy")))
    assert same_text(small) == same_text(whole)


def test_command_lines(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(spark, "stop", lambda: None)
    monkeypatch.setattr(type(spark.builder), "getOrCreate", lambda self: spark)
    assert repeat_sale_panel.main(["--tables", SF, "--out", f"{tmp_path}/panel", "--years", "1995", "1996"]) == 0
    assert {r.year for r in spark.read.parquet(f"{tmp_path}/panel/panel").select("year").distinct().collect()} <= {1995, 1996}
    assert evidence_register.main(["--documents", f"{SF}/documents.parque[t]", "--out", f"{tmp_path}/out", "--checkpoint", f"{tmp_path}/c"]) == 0
    assert evidence_register.read(spark, f"{tmp_path}/out").count() == spark.read.parquet(f"{SF}/documents.parquet").count()
