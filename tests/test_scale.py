"""What the findings of round 3 on growth ask of the operators, on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenure.operators import passes
from tenure.plans.registry import Tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def enriched(spark):
    from tenure.operators.tables import written

    return written(Tables(spark, SF).enriched, "enriched")


def test_rows_of_a_design_lie_together_and_are_added_up_first(enriched):
    rows = passes.rows_of(enriched, "borough", "bbl", keep=["sale_id_z"])
    design = F.filter("x", lambda e: e["k"] != "y").cast("string").alias("d")
    seen = rows.select(F.input_file_name().alias("f"), design).collect()
    runs = sum(a != b for a, b in zip(seen, seen[1:])) + 1
    assert runs == len(set(seen))
    draws, seed = 7, 3
    got = {(r["i"], r["j"], k): r[f"s{k}"] for r in passes._sums(rows, passes.drawn(np.arange(draws), seed), draws, None).collect() for k in range(draws)}
    want: dict = {}
    for r in rows.collect():
        w = np.searchsorted(np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 18)])), passes.uniform(np.array([r["c"]]), np.arange(draws), seed)[0], side="right")
        for a, x in enumerate(r["x"]):
            for b, z in enumerate(r["x"]):
                if x["k"] < z["k"] or (x["k"] == z["k"] != "y" and a <= b):
                    for k in range(draws):
                        key = (x["k"], z["k"], k)
                        want[key] = want.get(key, 0.0) + w[k] * x["v"] * z["v"] * (2 if x["k"] == z["k"] and a != b else 1)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_unique_lots_among_few_keys(spark):
    """All rows have one key: the answers are brute force's, odd prices included, and no join is by the key alone."""
    import datetime as dt

    from tenure.operators import linkage

    rng, day = np.random.default_rng(2), dt.date(1995, 1, 1)
    prices = [float("nan"), float("inf"), 0.0, -5.0, None, *rng.choice([100.0, 100.5, 101.0, 250.0], 60)]
    sales = [(i, "k" if i % 9 else None, day + dt.timedelta(int(rng.integers(0, 90))), None if p is None else float(p)) for i, p in enumerate(prices)]
    docs = [("k", day + dt.timedelta(int(rng.integers(-20, 60))), float(rng.choice([0.0, -5.0, 99.4, 99.6, 100.0, 100.5, 101.5, 250.0])), f"l{rng.integers(0, 12)}") for _ in range(40)]
    s = spark.createDataFrame(sales, "sale_id int, key string, sale_date date, price double")
    d = spark.createDataFrame(docs, "key string, doc_date date, amount double, lot string")
    got = linkage.unique_match(s, d, keys=["key"], target="lot", within=10)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert all("__span" in line for line in plan.splitlines() if "Join Inner" in line or "Join LeftSemi" in line)

    def agrees(a, p):
        return p is not None and (p != p or p == float("inf") or abs(a - p) <= 0.005 * p)

    want = {}
    for i, k, when, p in sales:
        dated = [x for x in docs if x[0] == k and abs((x[1] - when).days) <= 10]
        lots = sorted({x[3] for x in dated if agrees(x[2], p)})
        reason = "matched" if len(lots) == 1 else "ambiguous" if lots else "no amount" if dated else "no date"
        want[i] = (lots[0] if len(lots) == 1 else None, reason)
    assert {r["sale_id"]: (r["lot"], r["reason"]) for r in got.collect()} == want
    assert len(set(r for _, r in want.values())) == 4


def test_recodings_look_at_what_can_be_recoded(spark, enriched, monkeypatch):
    """An arm's keys are searched among its pairs and for the cells that recode it; recoded pairs are counted in the pass that refits."""
    from tenure.operators import relabel

    rows = relabel.design(enriched, "borough", "bbl", "sale_id_z", "financed_base_a", "financed_base_z")
    sizes, found = [], relabel.search
    monkeypatch.setattr(relabel, "search", lambda r, look, wanted, n: sizes.append((r.count(), n)) or found(r, look, wanted, n))
    relabel.hidden_labels(rows, [(0.0, 0.1), (0.1, 0.1)], draws=3, seed=3)
    arms = enriched.agg(F.sum("fc"), F.sum("cf")).first()
    assert sizes == [(arms[0], 3), (arms[1], 6)]
    refit = relabel.Recodings([{"name": "r", "h": 0.08, "f": 0.04, "mode": "random"}], 2, 1)
    for label in (relabel.CASH, relabel.FINANCED):
        refit.find(rows, label)
    values, counts = relabel.refitted(rows, refit.recoded, 2)
    labels = [x for r in enriched.select("financed_base_a", "financed_base_z").collect() for x in r]
    assert counts.tolist() == [round(0.08 * labels.count(0)) + round(0.04 * labels.count(1))] * 2 and np.isfinite(values).all()


def test_multinomial_draws_of_any_number_of_pairs(spark, enriched, monkeypatch):
    """One block gives the study's own sequence; many blocks give draws whose counts add up, and no sample is collected."""
    from tenure.operators import resampling
    from tenure.plans import statistics

    sample = resampling.sample(enriched, "borough", "bbl", order=["bbl", "sale_id_z"])
    want = {r["draw"]: r["value"] for r in resampling.bootstrap(spark, sample, resampling.ols, draws=8).collect()}
    rows = passes.rows_of(enriched, "borough", "bbl", keep=["bbl"])
    got = {r["draw"]: r["value"] for r in passes.multinomial(rows, "bbl", {"ols": ("cf", "fc")}, draws=8).collect()}
    assert got == pytest.approx(want, abs=1e-9)
    seen, sums = [], passes._sums
    monkeypatch.setattr(passes, "_sums", lambda r, weigh, *a, **k: seen.append((r, weigh)) or sums(r, weigh, *a, **k))
    monkeypatch.setattr(passes, "CLUSTERS", 20)
    many = [r["value"] for r in passes.multinomial(rows, "bbl", {"ols": ("cf", "fc")}, draws=40).collect()]
    dealt, weigh = seen[0]
    one = dealt.dropDuplicates(["block_", "code_"]).toPandas()
    assert one["block_"].nunique() > 2
    assert (weigh({c: one[c].to_numpy() for c in ("block_", "code_", "w")}).sum(axis=0) == len(one)).all()
    assert len(set(many)) == 40
    monkeypatch.setattr(resampling, "SAMPLE_ROWS", 1)
    monkeypatch.setattr(resampling, "sample", lambda *a, **k: pytest.fail("collected"))
    t = Tables(spark, SF)
    t.__dict__["enriched"] = enriched
    assert statistics.m07_publication(t).columns == ["estimator", "low", "high", "draws"]


def test_products_are_added_up_in_tasks(spark, enriched, monkeypatch):
    """Gram sums, with nulls and blocks, as the exploded rows give them, without exploding a row."""
    from tenure.operators import estimation

    rows = enriched.limit(200).withColumn("w", F.when(F.col("sale_id_z") % 7 > 0, F.col("sale_id_z") % 5)).withColumn("y", F.when(F.col("sale_id_z") % 3 > 0, F.col("y")))
    rows, entries = rows.withColumn("zipcode", F.when(F.col("sale_id_z") % 4 > 0, F.col("zipcode"))).localCheckpoint(), estimation.contrast_entries("borough")
    monkeypatch.setattr(estimation, "HELD", 50)
    for block in (None, "zipcode"):
        got = estimation.gram(rows, entries, F.col("w"), block)
        assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
        own = ["block"] if block else []
        flat = rows.select(entries.alias("x"), "w", F.col("zipcode").alias("block")).select("*", F.explode("x").alias("a")).select("*", F.explode("x").alias("b")).where("a.k <= b.k")
        want = flat.groupBy(*own, F.col("a.k").alias("i"), F.col("b.k").alias("j")).agg(F.sum(F.expr("a.v * b.v * w")).alias("s")).collect()
        of = lambda rs: {tuple(r[c] for c in (*own, "i", "j")): r["s"] for r in rs}
        assert of(got.collect()).keys() == of(want).keys()
        assert of(got.collect()) == pytest.approx(of(want), abs=1e-9)


def test_pairs_are_made_once(spark, monkeypatch):
    """m18, m20, m35 and m24 read the pairs several times: they are written down, and draws copy no pair."""
    from tenure.plans import equations, registry, statistics

    made = []
    monkeypatch.setattr(registry, "written", lambda df, name: made.append(name) or written(df, name))
    from tenure.operators.tables import written

    for f in (statistics.m18, statistics.m20, statistics.m35, equations.m35, equations.m24):
        made.clear()
        out = f(Tables(spark, SF))
        assert made == ["enriched"]
        if f is equations.m24:
            plan = out._jdf.queryExecution().optimizedPlan().toString()
            assert [line for line in plan.splitlines() if "Join" in line and "shuffle_hash" in line and "bbl" not in line]


def test_reweighing_reads_runs_of_numbers(spark, enriched, monkeypatch):
    """Passes of Huber's estimator read a row a run, not the rows with their names; rows without an order and with weights give the same."""
    rows = passes.rows_of(enriched, "borough", "bbl", weight=1 + F.col("sale_id_z") % 3)
    monkeypatch.setattr(passes, "RUN", 3)
    runs = passes.runs_of(rows, ["t:cf"])
    n = rows.count()
    assert max(len(r.y) for r in runs.collect()) == 3 and sum(len(r.y) for r in runs.collect()) == n
    weighed, sums = [], passes._sums
    monkeypatch.setattr(passes, "_sums", lambda *a, **k: weighed.append(a) or sums(*a, **k))
    beta, named, scale = passes.huber(rows.orderBy(F.rand(1)), ["cf", "fc"])
    assert len(weighed) == 1  # the start
    down = lambda own: own["w"] * np.minimum(1.0, passes.HUBER * scale / np.maximum(np.abs(own["e"]), 1e-12))
    again, _ = passes._one(rows, ["cf", "fc"], down, named)
    assert again.beta == pytest.approx(beta, abs=1e-7)
    weighed.clear()
    passes.fit_all(rows, beta)
    assert len(weighed) == 3


def test_draws_look_at_few_pairs_again(spark, monkeypatch):
    """All robust estimators of all draws take some eight looks at the pairs, as only those near a draw's cuts and limits are looked at in each step."""
    from tenure.operators import resampling
    from tenure.operators.tables import written

    pairs = written(Tables(spark, "/root/testdata/sf0.01").enriched.withColumn("parcel", F.xxhash64("bbl")), "enriched")
    rows = passes.rows_of(pairs, "borough", "bbl")
    seen, sums, searched, search = [], passes._sums, [], passes.search
    monkeypatch.setattr(passes, "_sums", lambda r, *a, **k: seen.append(r.count()) or sums(r, *a, **k))
    monkeypatch.setattr(passes, "search", lambda r, *a: searched.append(r.count()) or search(r, *a))
    got = {(r["draw"], r["estimator"]): r["value"] for r in passes.fit_all_draws(rows, draws=6, seed=3).collect()}
    n = pairs.count()
    assert sum(seen) < 10 * n and max(searched) < n
    sample = resampling.sample(pairs, "borough", "bbl", order=["bbl", "sale_id_z"], flags=["parcel"])
    w = passes.poisson(sample.flags["parcel"].astype(np.int64), np.arange(6), 3)
    for d in (0, 5):
        assert {name: got[d, name] for name in ("ols", "huber", *resampling.TRIMS)} == pytest.approx(resampling.fit_all(sample, w[:, d]), abs=1e-6)


def test_multinomial_weights_are_made_and_added_up_in_tasks(spark, monkeypatch):
    """NumPy's sequence, without a draw on the driver; a table of no pairs has draws of no clusters."""
    from tenure.operators import resampling

    rng = np.random.default_rng(7)
    want = [rng.multinomial(100_000, np.repeat(1 / 100_000, 100_000)) for _ in range(5)]
    monkeypatch.setattr(np.random, "default_rng", lambda *a: pytest.fail("drawn on the driver"))
    weights = resampling.multinomial_weights(spark, 100_000, 5, 7)
    got = {r["draw"]: np.frombuffer(r["weights"], dtype="<i2") for r in weights.collect()}
    assert sorted(got) == [0, 1, 2, 3, 4] and all((got[d] == w).all() for d, w in enumerate(want))
    assert sorted(map(tuple, resampling.counted(weights).collect())) == [(d, 100_000, 100_000) for d in range(5)]
    assert sorted(map(tuple, resampling.counted(resampling.multinomial_weights(spark, 0, 2, 7)).collect())) == [(0, 0, 0), (1, 0, 0)]
