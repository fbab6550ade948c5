"""Registered queries against their DuckDB oracles on the smallest tables."""

import pytest

from conftest import SMALL, duck

import __spark_entry__ as E
from careops.plans.catalog import ORACLES
from scripts.check_oracle import norm_rows

NAMES = list(ORACLES)


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SMALL)
    cur = con.execute(E.oracle_sql()[name])
    c1, r1 = norm_rows(df.columns, [tuple(r) for r in df.collect()])
    c2, r2 = norm_rows([d[0] for d in cur.description], cur.fetchall())
    assert c1 == c2
    assert r1 == r2


def test_every_query_has_a_callable_and_oracles_are_registered():
    qs, orc = E.queries(), E.oracle_sql()
    assert set(orc) <= set(qs)
    have = {n.split("_")[0] for n in qs}
    want = {f"b{i:02d}" for i in range(1, 19)} | {f"q{i:02d}" for i in range(1, 7)} | {"q07", "q10"} \
        | {"s01", "s02", "s03", "s04", "s06", "s07"} | {f"e0{i}" for i in range(1, 6)} \
        | {"f01", "f02", "f06", "f11", "f13", "k05", "m02", "m05", "m06", "m07", "m08", "m09"} \
        | {"v02", "v03", "v04", "v05", "v06", "v07", "w01", "w02", "w03", "w04", "c01", "c02", "c03"}
    assert want <= have, sorted(want - have)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["insurance_provider", "total_claims", "rejected_claims", "rejection_rate"]
    assert df.count() > 0
