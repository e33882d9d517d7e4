"""Every query with SQL against DuckDB, and every other one for rows and a stable schema."""

import math
import os

import duckdb
import pytest

from tenure.plans.catalogue import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    df, want = QUERIES[name](spark, SF), duck.sql(ORACLE_SQL[name])
    columns = sorted(want.columns)
    assert sorted(df.columns) == columns
    order = [want.columns.index(c) for c in columns]
    got = sorted(([plain(v) for v in r] for r in df.select(*columns).collect()), key=str)
    expected = sorted(([plain(r[i]) for i in order] for r in want.fetchall()), key=str)
    assert len(got) == len(expected)
    for a, b in zip(got, expected):
        assert all(x == y or isinstance(x, float) and y is not None and abs(x - y) < 1e-4 for x, y in zip(a, b)), (a, b)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    sf = "/root/testdata/sf0.01" if name == "m25_index_draws" else SF  # it wants 40 pairs an arm and segment
    assert QUERIES[name](spark, sf).count() > 0


def test_entry_without_the_optional_parts(monkeypatch, spark):
    import builtins

    import __spark_entry__ as e

    real = builtins.__import__

    def missing(name, *a, **k):
        if name in ("corpus_pipeline", "tenure.llm"):
            raise ModuleNotFoundError(name=name)
        return real(name, *a, **k)

    monkeypatch.setattr(builtins, "__import__", missing)
    jobs = {"job1_repeat_sale_panel", "job2_evidence_register"}
    assert set(e.queries()) == set(QUERIES) | jobs and set(e.oracle_sql()) == set(ORACLE_SQL) | jobs
    assert set(e.entry(spark).columns) == {"half_difference", "asymmetry", "cf", "fc"}
