"""Estimators, indexes and recodings of many draws at once, against fits and sorts of one draw at a time."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenure.operators import passes, relabel, resampling, search
from tenure.plans.registry import Tables

SF = "/root/testdata/sf0.001"
FLAGS = ["financed_base_a", "financed_base_z", "src", "arm", "parcel", "pair"]


@pytest.fixture(scope="module")
def pairs(spark):
    p = Tables(spark, SF).enriched.withColumns({"parcel": F.xxhash64("bbl"), "pair": F.xxhash64("sale_id_z")})
    return p.withColumns({"building_a": F.col("src") == "BUILDING", "building_z": F.col("src") == "BUILDING"}).cache()


@pytest.fixture(scope="module")
def sample(pairs):
    return resampling.sample(pairs, "borough", "bbl", order=["bbl", "sale_id_z"], flags=FLAGS)


@pytest.fixture(scope="module")
def rows(pairs):
    return relabel.design(pairs, "borough", "bbl", "sale_id_z", "financed_base_a", "financed_base_z", keep=["building_a", "building_z", "src"])


def index(sample, w):
    x = sample.x * np.sqrt(w)[:, None]
    return sample.y - sample.x @ np.linalg.lstsq(x, sample.y * np.sqrt(w), rcond=None)[0]


def test_all_estimators_of_many_draws(pairs, sample):
    design = passes.rows_of(pairs, "borough", "bbl")
    got = {(r.draw, r.estimator): r.value for r in passes.fit_all_draws(design, draws=5, seed=3).collect()}
    weights = passes.poisson(sample.flags["parcel"].astype(np.int64), np.arange(5), 3)
    for d in range(5):
        for name, value in resampling.fit_all(sample, weights[:, d]).items():  # Huber's rests within its tolerance
            assert got[d, name] == pytest.approx(value, abs=1e-4 if name == "huber" else 1e-9)
    assert len(got) == 20


def test_screens_in_one_pass_equal_passes_of_their_own(pairs):
    building, high = F.col("src") != "BUILDING", F.col("price_a") > 100_000
    masks = {"all": F.lit(True), "1": building, "1+2": building & high, "none known": F.lit(None).cast("boolean") | high}
    got = {(r.draw, r.estimator): r.value for r in passes.screened(pairs, masks, "borough", "bbl", draws=3, seed=3).collect()}
    for name, mask in masks.items():
        own = passes.bootstrap(passes.rows_of(pairs.where(mask), "borough", "bbl"), {"ols": ("cf", "fc")}, draws=3, seed=3)
        assert {r.draw: r.value for r in own.collect()} == pytest.approx({d: got[d, name] for d in range(3)}, abs=1e-8)


def test_an_index_of_each_draw_equals_one_of_duplicated_rows(pairs, sample):
    design = passes.rows_of(pairs.withColumn("grp", F.concat_ws("|", "src", "arm")), "borough", "bbl", keep=["grp"])
    got = {(r.draw, r.grp): (r.n, r.mean) for r in passes.index_draws(design, "grp", draws=4, seed=3).collect()}
    weights = passes.poisson(sample.flags["parcel"].astype(np.int64), np.arange(4), 3).astype(int)
    groups = np.array([f"{s}|{a}" for s, a in zip(sample.flags["src"], sample.flags["arm"])])
    for d in range(4):
        often = np.repeat(np.arange(len(sample.y)), weights[:, d])  # rows as often as their parcel was drawn
        r = index(sample.rows(often), np.ones(len(often)))
        for g in np.unique(groups[often]):
            assert got.pop((d, g)) == (pytest.approx((groups[often] == g).sum()), pytest.approx(r[groups[often] == g].mean(), abs=1e-8))
    assert not got
    values = passes.index_contrasts(passes.index_draws(design, "grp", draws=2, seed=3)).collect()
    assert {r.segment for r in values} <= set(sample.flags["src"]) and values
    assert passes.index_contrasts(passes.index_draws(design, "grp", draws=2, seed=3), least=10**6).isEmpty()


def test_placebos_are_of_pairs_that_don_t_switch(spark, sample):
    from tenure.plans.catalogue import QUERIES

    r, still = index(sample, np.ones(len(sample.y))), np.isin(sample.flags["arm"], ["cc", "ff"])
    label = passes.uniform(sample.flags["pair"].astype(np.int64), np.arange(400), 1) <= 0.5
    got = QUERIES["m26_placebo_labels"](spark, SF).orderBy("draw").collect()
    for d in (0, 1, 399):
        a, b = r[still & label[:, d]], r[still & ~label[:, d]]
        want = (a.mean() - b.mean()) / 2, a.mean() + b.mean(), len(a), len(b)
        assert (got[d].half_difference, got[d].asymmetry, got[d].cf, got[d].fc) == pytest.approx(want, abs=1e-8)


SCENARIOS = [
    {"name": "random", "h": 0.08, "f": 0.036, "mode": "random"}, {"name": "against", "h": 0.08, "f": 0.036, "mode": "tilted", "sign": 1.0},
    {"name": "for", "h": 0.08, "f": 0.036, "mode": "tilted", "sign": -1.0}, {"name": "worst", "h": 0.08, "f": 0.036, "mode": "adversarial"},
    {"name": "best", "h": 0.188, "f": 0.064, "mode": "adversarial", "sign": -1.0}, {"name": "company", "h": 0.08, "f": 0.0, "mode": "random", "pool": "building"},
    {"name": "none", "h": 0.0, "f": 0.0, "mode": "random"}, {"name": "all", "h": 1.0, "f": 1.0, "mode": "random"},
    *[{"name": f"kappa {k}", "h": 0.08, "f": 0.036, "mode": "tilted", "kappa": k / 10} for k in range(11)],
]


def by_sorting(sample, c, column, seed):
    """New labels of one scenario and draw: ends sorted by their keys, taken one by one."""
    fa, fz = (sample.flags[f].astype(int) for f in ("financed_base_a", "financed_base_z"))
    keys, n = sample.flags["pair"].astype(np.int64), len(fa)
    r = index(sample, np.ones(n))
    effect = np.stack([r * (relabel.switch(fa, fz) - relabel.switch(1 - fa, fz)), r * (relabel.switch(fa, fz) - relabel.switch(fa, 1 - fz))], axis=1)
    labels, new, taken = np.stack([fa, fz], axis=1), [fa.copy(), fz.copy()], set()
    for label, share in ((0, c["h"]), (1, c["f"])):
        pool = [(k, e) for k, e in np.argwhere(labels == label).tolist() if k not in taken and not (label == 0 and "pool" in c and sample.flags["src"][k] != "BUILDING")]
        want, at = int(np.rint(share * (labels == label).sum())), tuple(np.array(pool, dtype=int).reshape(-1, 2).T)
        signed = c.get("sign", 1.0) * effect[at]
        if c["mode"] == "adversarial":
            key = -signed
        else:
            u = np.stack([passes.uniform(keys, np.array([column]), seed + 2 * label + e)[:, 0] for e in (0, 1)], axis=1)[at]
            key = -np.log(u) / (np.exp(c.get("kappa", 1.0) * (signed - signed.mean()) / signed.std()) if c["mode"] == "tilted" else 1)
        count = 0
        for q in np.argsort(key, kind="stable"):
            k, e = pool[q]
            if count < want and k not in taken:
                taken.add(k)
                new[e][k] = 1 - label
                count += 1
    return new, len(taken)


def refit(sample, a, z, keep=None):
    keep = np.ones(len(a), dtype=bool) if keep is None else keep
    v = relabel.switch(a, z)[keep]
    s = sample.rows(keep)
    return resampling.half(resampling.wls(s.design, np.column_stack([v == 1, v == -1]).astype(float), s.y, np.ones(len(v)))[0])


def test_recodings_equal_a_sort_of_the_same_keys(rows, sample):
    got = {(r.scenario, r.draw): (r.value, r.recoded) for r in relabel.relabelling(rows, SCENARIOS, draws=2, seed=4).collect()}
    assert len(got) == 2 * len(SCENARIOS)
    for i, c in enumerate(SCENARIOS):
        for d in range(2):
            (a, z), n = by_sorting(sample, c, 2 * i + d, 4)
            assert got[c["name"], d][1] == n
            if c["name"] != "all":  # there the arms may vanish
                assert got[c["name"], d][0] == pytest.approx(refit(sample, a, z), abs=1e-9)
    assert got["none", 0] == (pytest.approx(refit(sample, sample.flags["financed_base_a"].astype(int), sample.flags["financed_base_z"].astype(int)), abs=1e-9), 0)


def test_hidden_labels_equal_a_sort_of_the_same_keys(rows, sample):
    cells = [(0.0, 0.0), (0.1, 0.2), (0.2, 0.1)]
    got = {(r.q_fc, r.q_cf, r.draw): (r.full, r.screened) for r in relabel.hidden_labels(rows, cells, draws=2, seed=3, screen=F.col("src") != "BUILDING").collect()}
    fa, fz = (sample.flags[f].astype(int) for f in ("financed_base_a", "financed_base_z"))
    for i, (fc, cf) in enumerate(cells):
        for d in range(2):
            a, z = fa.copy(), fz.copy()
            for arm, share, side in ((-1, fc, z), (1, cf, a)):
                own = np.flatnonzero(relabel.switch(fa, fz) == arm)
                u = passes.uniform(sample.flags["pair"].astype(np.int64)[own], np.array([2 * i + d]), 3 + arm)[:, 0]
                side[own[np.argsort(u)][: int(np.rint(share * len(own)))]] = 1
            assert got[fc, cf, d] == pytest.approx((refit(sample, a, z), refit(sample, a, z, sample.flags["src"] != "BUILDING")), abs=1e-9)


def test_values_of_the_queries(spark, sample):
    """What the queries without SQL return, against the collected sample."""
    from tenure.plans.catalogue import QUERIES

    ones = np.ones(len(sample.y))
    down, (beta, weights) = resampling.robust_report(sample), resampling.huber(sample.design, sample.q, sample.y, ones)
    assert {r.estimator: r.value for r in QUERIES["m14_all_estimators"](spark, SF).collect()} == pytest.approx(down["point"], abs=1e-6)
    row = QUERIES["m13_huber"](spark, SF).first()
    assert (row.half_difference, row.down_weighted) == pytest.approx((resampling.half(beta), (weights < 1).mean()), abs=1e-6)
    for r in QUERIES["m15_robust_report"](spark, SF).collect():
        assert (r.down_weighted, r.tail, r.huber) == pytest.approx((down["down_weighted"][r.arm], down["tails"][r.arm], down["point"]["huber"]), abs=1e-6)


def test_adverse_outcomes_and_windows(spark, pairs, sample):
    """m22 by the weights that the collected design gives, m35 by refits with each window's labels."""
    from tenure.plans.catalogue import QUERIES

    ones = np.ones(len(sample.y))
    q = sample.design.residuals(sample.q, ones)
    k = q @ np.linalg.inv(q.T @ q) @ np.array([0.5, -0.5])
    parcels, of = np.unique(sample.flags["parcel"], return_inverse=True)
    names = {r.parcel: r.bbl for r in pairs.select("parcel", "bbl").distinct().collect()}
    weight = np.bincount(of, np.abs(k))
    order = sorted(range(len(parcels)), key=lambda i: (-round(weight[i], 12), names[parcels[i]]))
    for r in QUERIES["m22_adverse_outcomes"](spark, SF).collect():
        hit = np.isin(of, order[: r.parcels])
        assert r.contrast == pytest.approx((k * (sample.y - hit * np.sign(k) * r.delta)).sum(), abs=1e-7)
    got = {r.window: r for r in QUERIES["m35_window_sensitivity"](spark, SF).collect()}
    labels = pairs.orderBy("bbl", "sale_id_z").select(*[f"financed_{w}_{e}" for w in ("strict", "base", "wide") for e in "az"]).collect()
    for w in ("strict", "base", "wide"):
        a, z = (np.array([r[f"financed_{w}_{e}"] for r in labels]) for e in "az")
        assert got[w].pi_joint == pytest.approx(refit(sample, a, z), abs=1e-8)
        assert (got[w].cf, got[w].fc) == ((relabel.switch(a, z) == 1).sum(), (relabel.switch(a, z) == -1).sum())


@pytest.mark.parametrize("values", ["outliers", "ties", "plain"])
def test_searches_hold_few_values(spark, monkeypatch, values):
    """Two values far out don't keep the range wide; a value that most rows share counts as one."""
    rng = np.random.default_rng(1)
    v = rng.normal(size=(4000, 3))
    if values == "outliers":
        v[0], v[1] = 1e6, -1e6
    if values == "ties":
        v[:3000] = 0.5
    w = rng.integers(0, 3, (4000, 3)).astype(float) if values == "plain" else np.ones((4000, 3))
    df = spark.createDataFrame([(*map(float, a), *map(float, b)) for a, b in zip(v, w)], ", ".join(f"{c}{i} double" for c in "vw" for i in range(3))).repartition(3)
    stack = lambda b, c: np.stack([b.column(f"{c}{i}").to_numpy() for i in range(3)], axis=1)
    monkeypatch.setattr(search, "CELLS", 900)
    for share in (0.0, 0.01, 0.5, 0.975, 1.0):
        found = search.search(df, lambda b: (stack(b, "v"), stack(b, "w")), lambda total, share=share: share * total, 3)
        assert all(len(f.values) <= search.FEW for f in found)
        for i, f in enumerate(found):
            want = resampling.weighted_quantile(v[w[:, i] > 0, i], w[w[:, i] > 0, i], [100 * share])[0]
            assert f.quantile() == pytest.approx(want, abs=1e-12)
    order = search.search(df, lambda b: (stack(b, "v"), np.ones((len(b), 1))), lambda _: np.array([0, 17, 5000]), 3)
    assert [f.nth() for f in order] == [-np.inf, np.sort(v[:, 1])[16], np.inf]


def test_limits_are_looked_for_near_what_is_expected(rows, sample, monkeypatch):
    """Only the worst recodings are searched, in one column; a limit that lies elsewhere is looked for further out; a pool may have too few."""
    some = [SCENARIOS[1], SCENARIOS[3], {"name": "few", "h": 0.9, "f": 0.02, "mode": "random", "pool": "building"}, {"name": "most", "h": 0.5, "f": 0.9, "mode": "tilted"}]
    searched, found, looks, limits = [], relabel.search, [], relabel.Recodings._limits
    monkeypatch.setattr(relabel, "search", lambda r, look, wanted, n: searched.append(n) or found(r, look, wanted, n))
    monkeypatch.setattr(relabel.Recodings, "_limits", lambda self, *a: looks.append(a) or limits(self, *a))
    got = {(r.scenario, r.draw): (r.value, r.recoded) for r in relabel.relabelling(rows, some, draws=3, seed=4).collect()}
    assert searched == [1, 1] and len(looks) == 2
    monkeypatch.setattr(relabel, "REACH", 0.01)
    assert {(r.scenario, r.draw): (r.value, r.recoded) for r in relabel.relabelling(rows, some, draws=3, seed=4).collect()} == got
    assert len(looks) > 4
    for i, c in enumerate(some):
        for d in range(3):
            (a, z), n = by_sorting(sample, c, 3 * i + d, 4)
            assert got[c["name"], d] == (pytest.approx(refit(sample, a, z), abs=1e-9), n)


def test_few_cells_are_given_new_switches():
    """A pass gives the cells that are recoded, not all pairs and draws; the worst are the same in every draw."""
    n = 1000
    rng = np.random.default_rng(1)
    own = {"pair": rng.integers(-(2**62), 2**62, n), "fa": rng.integers(0, 2, n), "fz": rng.integers(0, 2, n), "r": rng.normal(size=n)}
    f = relabel.Recodings([{"name": "r", "h": 0.1, "f": 0.1, "mode": "random"}, {"name": "w", "h": 0.1, "f": 0.1, "mode": "adversarial"}], 50, 1)
    f.limit = {0: np.append(np.full(50, 0.02), -0.5), 1: np.append(np.full(50, 0.03), -0.7)}
    row, column, new = f.recoded(own)
    assert f.width == 51 and set(column) == set(range(51)) and len(set(zip(row, column))) == len(row) < 0.1 * n * 51
    u = [[passes.uniform(own["pair"], np.arange(50), 1 + 2 * label + end) for end in (0, 1)] for label in (0, 1)]
    labels = np.stack([own["fa"], own["fz"]], axis=1)
    key = [np.min([np.where((labels[:, e] == label)[:, None], -np.log(u[label][e]), np.inf) for e in (0, 1)], axis=0) for label in (0, 1)]
    assert ((column < 50).sum()) == ((key[0] <= 0.02) | (key[1] <= 0.03)).sum()


def test_worst_recodings_are_made_once(spark, monkeypatch):
    """m29_misclassification has a column a draw for the random and tilted scenarios and one for each of the worst, whose 200 draws are alike."""
    from tenure.plans.catalogue import QUERIES

    widths, refitted = [], relabel.refitted
    monkeypatch.setattr(relabel, "refitted", lambda rows, switches, width, *a, **k: widths.append(width) or refitted(rows, switches, width, *a, **k))
    got = {r.scenario: r for r in QUERIES["m29_misclassification"](spark, SF).collect()}
    assert widths == [3 * 200 + 2] and {r.draws for r in got.values()} == {200}
    assert got["adversarial_against"].value < got["tilted_against"].value < got["random"].value < got["tilted_for"].value < got["adversarial_for"].value
