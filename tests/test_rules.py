"""Hand-made rows for the rules on ties, edges and missing values."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tenure.functions import keys, measures, names
from tenure.operators import linkage, pairing, parties, screens, summary

DAY = dt.date(2020, 1, 1)


def at(n):
    return DAY + dt.timedelta(days=n)


def sales(spark, *days, price=50.0, bbl="p"):
    return spark.createDataFrame([(i, bbl, at(d), price) for i, d in enumerate(days)], "sale_id long, bbl string, sale_date date, price double")


def docs(spark, *rows):
    return spark.createDataFrame([(i, "p", at(d), float(a)) for i, d, a in rows], "doc_id string, bbl string, doc_date date, amount double")


def one(spark, *columns, **values):
    schema = ", ".join(f"{k} {'double' if isinstance(v, float) else 'long' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(*columns).first()


@pytest.mark.parametrize(("gap", "kept"), [(1094, 0), (1095, 1)])
def test_hold_boundary(spark, gap, kept):
    p = pairing.consecutive(sales(spark, 0, gap), "bbl", ["sale_date"], carry=["sale_id", "sale_date"], day="sale_date", hold=1095)
    assert p.count() == kept


def test_filter_comes_after_pairing(spark):
    p = pairing.consecutive(sales(spark, 0, 100, 1300), "bbl", ["sale_date"], carry=["sale_id", "sale_date"], day="sale_date", hold=1095)
    assert [(r.sale_id_a, r.sale_id_z) for r in p.collect()] == [(1, 2)]


def test_drop_then_pair_bridges(spark):
    s = sales(spark, 0, 600, 1300).withColumn("label", F.when(F.col("sale_id") == 1, -1).otherwise(1))
    pair = lambda x: pairing.consecutive(x, "bbl", ["sale_date"], carry=["sale_id", "sale_date", "label"], day="sale_date", hold=500)
    assert pair(s.where("label >= 0")).count() == 1 and pair(s).where("label_a >= 0 and label_z >= 0").count() == 0


def test_flip_filter_looks_at_the_original_previous(spark):
    kept = pairing.drop_flips(sales(spark, 0, 100, 500), "bbl", ["sale_date"], "sale_date", 365)
    assert [r.sale_id for r in kept.orderBy("sale_id").collect()] == [0, 2]


@pytest.mark.parametrize(("day", "flags"), [(-16, (0, 0, 0)), (-15, (1, 1, 1)), (30, (1, 1, 1)), (31, (0, 1, 1)), (90, (0, 1, 1)), (91, (0, 0, 1)), (180, (0, 0, 1)), (181, (0, 0, 0))])
def test_window_edges(spark, day, flags):
    windows = {"strict": (-15, 30), "base": (-15, 90), "wide": (-15, 180)}
    r = linkage.window_flags(sales(spark, 0), docs(spark, ("d", day, 7)), windows, amount_in="base").first()
    assert (r.financed_strict, r.financed_base, r.financed_wide) == flags and r.mort_amt == (7 if flags[1] else 0)


@pytest.mark.parametrize(("rows", "doc", "ties"), [([("a", 3, 1), ("b", -3, 1)], None, 2), ([("a", 3, 1), ("a", -3, 1)], "a", 1), ([("a", 3, 1), ("b", 4, 1)], "a", 1), ([("a", 46, 1)], None, 0)])
def test_nearest_is_unique_or_null(spark, rows, doc, ties):
    r = linkage.nearest_unique(sales(spark, 0), docs(spark, *rows)).first()
    assert (r.doc_id, r.nearest_ties) == (doc, ties)


def test_two_deeds_of_one_lot_match(spark):
    d = docs(spark, ("a", 1, 50), ("b", 2, 50)).withColumn("lot", F.lit("1001"))
    assert linkage.unique_match(sales(spark, 0), d, keys=["bbl"], target="lot").first().reason == "matched"
    assert linkage.unique_match(sales(spark, 0), d, keys=["bbl"]).first().reason == "ambiguous"


@pytest.mark.parametrize(("amount", "ok"), [(51.0, True), (51.01, False), (49.0, True), (0.0, False)])
def test_amount_tolerance(spark, amount, ok):
    assert one(spark, measures.amount_matches(F.col("a"), F.col("p")).alias("x"), a=amount, p=50.0).x is ok


def test_mutual_uniqueness_and_count_rule(spark):
    two = sales(spark, 0, 20)
    assert [r.label for r in linkage.mutual_unique(two, docs(spark, ("f", 25, 1)), -15, 90).collect()] == [-1, -1]
    assert linkage.mutual_unique(sales(spark, 0), docs(spark, ("f", 25, 1)), -15, 90).first().label == 1
    r = linkage.count_rule(two, docs(spark, ("f", 25, 1)), eligible=F.col("sale_id") == 0).first()
    assert (r.k, r.all_k, r.m, r.legacy, r.all_competitors) == (1, 2, 1, 1, -1)
    assert linkage.count_rule(sales(spark, 0), docs(spark, ("f", 136, 1))).first().legacy == 0


def test_ineligible_sales_compete(spark):
    s = sales(spark, 0, 20)
    r = linkage.mutual_unique(s, docs(spark, ("f", 25, 1)), -15, 90, eligible=F.col("sale_id") == 0).collect()
    assert [(x.sale_id, x.label, x.competing) for x in r] == [(0, -1, 2)]


def test_multi_parcel_filing_is_excluded(spark):
    lots = spark.createDataFrame([("d", "1"), ("d", "2"), ("e", "1"), ("e", "1")], "document_id string, bbl string")
    assert [tuple(r) for r in linkage.single_parcel(lots.select("document_id").distinct(), lots).collect()] == [("e", "1")]


@pytest.mark.parametrize(("a", "b", "unit"), [(" 6 c ", None, "6 C"), ("", "345 W 55TH ST, 6C", "6C"), (None, None, ""), ("  ", "1 MAIN ST", "")])
def test_unit(spark, a, b, unit):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(keys.unit_key(F.col("a"), F.col("b"))).first()[0] == unit


@pytest.mark.parametrize("day", [0, 10])
def test_permit_on_an_endpoint_counts(spark, day):
    p = spark.createDataFrame([("p", at(0), at(10))], "bbl string, date_a date, date_z date")
    q = spark.createDataFrame([("p", at(day))], "bbl string, issued date")
    assert linkage.exists_between(p, q, "bbl", "date_a", "date_z", "issued").count() == 1
    assert linkage.flag_between(p, q, "bbl", "date_a", "date_z", "issued", "hit").first().hit


def test_dates_and_keys_never_raise(spark):
    df = spark.createDataFrame([("13/45/2016",), ("01/02/2009",), ("01/02/2015",), (None,), ("x",)], "d string")
    assert [r[0] for r in df.select(keys.us_date(F.col("d"), 2010)).collect()] == [None, None, dt.date(2015, 1, 2), None, None]
    assert [r[0] for r in df.select(keys.number_or(F.col("d"))).collect()] == [0.0] * 5
    k = spark.createDataFrame([("1", "2", "3"), ("1", "123456", "12345"), ("a", "2", "3")], "b string, k string, l string")
    assert [r[0] for r in k.select(keys.compose_parcel(F.col("b"), F.col("k"), F.col("l"))).collect()] == ["1000020003", "112345612345", None]
    assert one(spark, keys.parcel_from_number(F.col("x")).alias("y"), x="4162340021.00000000").y == "4162340021"


def test_as_of(spark):
    left = sales(spark, -1, 0, 3, 7, 900)
    right = spark.createDataFrame([(at(0), 1.0), (at(7), 2.0)], "d date, rate double")
    want = [None, 1.0, 1.0, 2.0, 2.0]
    got = linkage.as_of(left, right, "sale_date", "d", "rate").orderBy("sale_id").collect()
    assert [r.rate for r in got] == want
    keyed = linkage.as_of(left, right.withColumn("bbl", F.lit("p")), "sale_date", "d", "rate", keys=["bbl"]).orderBy("sale_id").collect()
    assert [r.rate for r in keyed] == want
    assert linkage.as_of(left, right.limit(0), "sale_date", "d", "rate").where("rate is null").count() == 5


@pytest.mark.parametrize(("name", "surname"), [("SMITH, JOHN", "SMITH"), ("ACME LLC", None), ("X, Y", None), ("SMITH JOHN", None), ("ACME CO., NYC", "ACME CO."), (" jones , a", "JONES"), (None, None)])
def test_surname(spark, name, surname):
    assert spark.createDataFrame([(name,)], "n string").select(names.surname(F.col("n"))).first()[0] == surname


def test_party_categories(spark):
    df = spark.createDataFrame([(["FAMILY TRUST LLC"],), (["A TRUST", "B"],), (["", None],), ([],), (["DOE, J"],), (None,)], "n array<string>")
    assert [r[0] for r in df.select(names.party_category(F.col("n"))).collect()] == ["entity", "trust", "unknown", "unknown", "person", "unknown"]


@pytest.mark.parametrize(("address", "key"), [("12 Main Street Apt 4", ("12 MAIN ST", "NEW YORK", "10001")), ("PO BOX 9", None), ("MAIN ST", None), ("C/O X 12 A ST", None), (None, None)])
def test_street_key(spark, address, key):
    df = spark.createDataFrame([(address, "New York", "10001-22")], "a string, c string, z string")
    got = df.select(names.street_key(F.col("a"), F.col("c"), F.col("z"))).first()[0]
    assert (tuple(got) if got else None) == key


def test_related_parties_and_addresses(spark):
    rows = [("d", "1", "LEE, A"), ("d", "2", "LEE, B"), ("e", "1", "LEE, A"), ("e", "2", "ROSS, B"), ("f", "1", "KIM, A"), ("f", "2", "KIM, B"), ("g", "3", "LEE, A")]
    p = spark.createDataFrame(rows, "document_id string, party_type string, name string")
    got = {r.document_id: (r.related, r.related_strict) for r in parties.related(p, common=1).collect()}
    assert got == {"d": (True, False), "e": (False, False), "f": (True, True)}
    a = p.withColumns({"address_1": F.when(F.col("document_id") == "d", "1 A ST").otherwise(F.concat(F.lit("1 "), "name")), "city": F.lit("X"), "zip": F.lit("10001")})
    assert {r.document_id for r in parties.shared_address(a).where("shared_address").collect()} == {"d"}
    flags = {r.document_id: r.buyer_unknown for r in parties.category_indicators(p).collect()}
    assert flags["d"] == 0 and flags["g"] == 1


@pytest.mark.parametrize(("ltv", "some"), [(0.05, False), (0.0501, True), (1.05, True), (1.06, False)])
def test_tax_bounds(spark, ltv, some):
    r = one(spark, measures.tax_burden(F.col("l"), F.col("p")).alias("x"), l=ltv * 1000, p=1000.0).x
    assert (r is not None) is some


def test_tax_step(spark):
    rate = lambda loan: one(spark, measures.tax_burden(F.col("l"), F.col("p")).alias("x"), l=loan, p=1e6).x / (loan / 1e6)
    assert rate(499_999.0) == pytest.approx(0.018) and rate(500_000.0) == pytest.approx(0.01925)


def test_wilson_and_inversion(spark):
    low, high = measures.wilson(F.col("h"), F.col("n"))
    r = one(spark, low.alias("l"), high.alias("h"), h=4, n=50)
    assert (round(r.l, 4), round(r.h, 4)) == (0.0315, 0.1884)
    assert one(spark, measures.invert_discount(F.col("p"), F.col("q")).alias("d"), p=0.0925135, q=0.1).d == pytest.approx(0.87235, abs=1e-4)


def test_masks_and_guards(spark):
    df = spark.createDataFrame([(1, None), (2, True), (3, False)], "i long, b boolean")
    got = screens.cumulative(df, {"m": F.col("b"), "n": F.col("i") > 0}).orderBy("i").collect()
    assert [(r.m, r.n) for r in got] == [(False, False), (True, True), (False, False)]
    s = spark.createDataFrame([(99, 50, 50), (100, 19, 50), (100, 20, 20)], "n int, a int, b int")
    assert [r[0] for r in s.select(screens.support_status(F.col("n"), F.col("a"), F.col("b"))).collect()] == ["too few pairs", "too few switchers", "ok"]


def test_common_name_ties_are_alphabetical(spark):
    df = spark.createDataFrame([("1", "B"), ("2", "A"), ("3", "C"), ("4", "C")], "d string, s string")
    assert [r.s for r in summary.common_names(df, ["d"], "s", 2).collect()] == ["C", "A"]


def test_unique_keys_are_enforced(spark):
    left = sales(spark, 0)
    with pytest.raises(ValueError):
        linkage.join_one(left, spark.createDataFrame([("p", 1), ("p", 2)], "bbl string, v int"), ["bbl"])


@pytest.mark.parametrize("spread", ["year", "month"])
def test_spreading_a_hot_key_changes_nothing(spark, spread):
    import random

    rng = random.Random(4)
    rows = [(i, rng.choice("aab"), at(rng.randrange(900)), float(i)) for i in range(400)]
    df = spark.createDataFrame(rows, "sale_id long, bbl string, sale_date date, price double")
    pair = lambda s: pairing.consecutive(
        df, "bbl", ["sale_date", "sale_id"], carry=["sale_id", "sale_date"], same=["price"], day="sale_date", hold=2, spread=s
    )
    assert sorted(map(tuple, pair(spread).collect())) == sorted(map(tuple, pair(None).collect()))
    count = lambda s: pairing.rolling_count(df, "bbl", "sale_date", 45, "near", F.col("price") > 50, spread=s)
    assert sorted(map(tuple, count(True).collect())) == sorted(map(tuple, count(False).collect()))


def test_shared_ends_equal_enumeration(spark):
    import random

    r = random.Random(4)
    rows = [(i, r.choice(["p", "q", "r", None]), r.randrange(7), r.randrange(7)) for i in range(60)]
    rows += [(60, "s", 1, 1), (61, "s", 1, 1), (62, None, 90, 91), (63, "u", 92, 93), (64, "u", 94, 95)]
    df = spark.createDataFrame(rows, "id long, bbl string, a int, z int")
    got = {x.id: x.sharing for x in linkage.shared_ends(df, "bbl", "a", "z").collect()}
    share = lambda p, q: p[1] is not None and p[1] == q[1] or bool({p[2], p[3]} & {q[2], q[3]})
    assert got == {p[0]: sum(share(p, q) for q in rows) for p in rows}


def test_whole_tables_not_parts_of_them(spark):
    from tenure.plans.catalogue import QUERIES
    from tenure.plans.registry import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    n = t.pairs.count()
    pairs = [(x.sale_id_z, x.bbl, *x[2:]) for x in t.pairs.selectExpr("sale_id_z", "bbl", "year(date_a) * 4 + quarter(date_a)", "year(date_z) * 4 + quarter(date_z)").collect()]
    got = {x.id: x.sharing for x in QUERIES["j21_shared_ends_all"](spark, t.sf_dir).collect()}
    assert got == {p[0]: sum(p[1] == q[1] or bool({*p[2:]} & {*q[2:]}) for q in pairs) for p in pairs}
    assert QUERIES["j19_locate_all"](spark, t.sf_dir).count() == n == len(got)
    assert QUERIES["w08_long_gaps_all"](spark, t.sf_dir).select("borough", "zipcode").distinct().count() == t.sales.select("borough", "zipcode").distinct().count()
