import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenure.llm import quality_classifier as qc
from tenure.llm import quality_rules as qr

from .helpers import awkward, empty, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    w = WORD.findall(text or "")
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_base_statistics_equal_brute_force(spark):
    docs = table(spark, "documents").select("doc_id", "text").unionByName(awkward(spark).select("doc_id", "text"))
    got = qr.statistics(docs.withColumn("doc_id", F.struct("doc_id", "text"))).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base(r.doc_id.text), r.doc_id.doc_id


def test_repeated_windows(spark):
    text = " ".join(["a b c d e f g h i"] * 3) + " tail"
    r = qr.statistics(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r.n_repeat_words == base(text)[4] > 0


def test_rules_are_learned_native_and_keep_good_texts(spark):
    docs, labels = table(spark, "documents", "/root/testdata/sf0.01"), table(spark, "labels", "/root/testdata/sf0.01")
    out = qr.judge(docs, labels)
    for df in (out, qr.statistics(docs)):  # judge reads its statistics back from a table, so their own plan is looked at too
        plan = df._jdf.queryExecution().toString()
        assert not any(s in plan for s in ("Python", "Arrow", "InPandas"))
    rows = out.join(labels, "doc_id").collect()
    good = [r for r in rows if r.quality == 1 and not r.base_failed]
    bad = [r for r in rows if r.quality == 0]
    assert np.mean([r.kept for r in good]) > 0.98
    assert np.mean([not r.kept for r in bad]) > 0.9
    assert all(not r.kept for r in rows if r.base_failed)


def test_rules_hold_on_labels_not_learned_from(spark):
    docs, labels = table(spark, "documents", "/root/testdata/sf0.01"), table(spark, "labels", "/root/testdata/sf0.01")
    rest = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    rows = qr.judge(docs, labels.where(~rest)).join(labels.where(rest), "doc_id").collect()
    good = [r for r in rows if r.quality == 1 and not r.base_failed]
    bad = [r for r in rows if r.quality == 0]
    assert np.mean([r.kept for r in good]) > 0.95
    assert np.mean([not r.kept for r in bad]) > 0.85


def test_decision_list_order_and_sql():
    rules = [qr.Rule([("symbols", True, 0.5), ("upper", False, 0.1)]), qr.Rule([("distinct", False, 0.4)])]
    assert "CASE WHEN" in str(qr.verdict(rules)._jc.toString()) and qr.verdict([]) is not None


def test_learner_finds_a_planted_conjunction(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(600):
        symbols, upper = int(rng.integers(0, 100)), int(rng.integers(0, 500))
        bad = symbols > 50 and upper > 250
        rows.append((i, 100, 500, symbols, 0, 0, 10, upper, 0, 90, 0 if bad else 1))
    columns = ", ".join(f"{c} long" for c in ("doc_id", *qr.COUNTS)) + ", quality int"
    rules = qr.learn(spark.createDataFrame(rows, columns))
    assert rules and {c[0] for c in rules[0].conditions} == {"symbols", "upper"}
    cuts = {c[0]: c[2] for c in rules[0].conditions}
    assert abs(cuts["symbols"] - 0.505) < 0.05 and abs(cuts["upper"] - 0.5) < 0.05


@pytest.mark.parametrize("docs", [awkward, empty])
def test_rules_on_awkward_tables(spark, docs):
    d = docs(spark)
    out = qr.judge(d, spark.createDataFrame([(1, 1), (None, 0), (6, None)], "doc_id long, quality int"))
    assert out.count() == d.count()
    assert all(not r.kept for r in out.collect() if r.n_words < 20)


def test_classifier_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, "documents", sf), table(spark, "labels", sf)
    rows = qc.classify(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert np.mean([r.predicted == r.quality for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_held_out_labels_are_not_learned_from(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, "documents", sf).limit(300), table(spark, "labels", sf)
    flipped = labels.withColumn("quality", F.when(qc.fold(F.col("doc_id")) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (qc.classify(docs, x).orderBy("doc_id").collect() for x in (labels, flipped))
    assert [r.score for r in a] == pytest.approx([r.score for r in b], abs=1e-9)


def test_isotonic_is_monotone_least_squares():
    x = np.arange(6.0)
    knots, values = qc.isotonic(x, np.ones(6), np.array([0, 1, 0, 0, 1, 1.0]))
    assert list(values) == pytest.approx([0, 1 / 3, 1]) and (np.diff(knots) > 0).all()


@pytest.mark.parametrize("docs", [awkward, empty])
@pytest.mark.parametrize("labels", [[(1, 1), (None, 0), (6, None)], [], [(1, 1), (6, 0), (7, 1), (8, 0)]])
def test_classifier_on_awkward_tables(spark, docs, labels):
    d = docs(spark)
    out = qc.classify(d, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert len(out) == d.count() and all(0 <= r.score <= 1 for r in out)
