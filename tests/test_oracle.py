"""Every registered query against its DuckDB oracle on sf0.001, the driver
contract, and the fixture counts of FIXTURES §3.2."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from bench import HEADLINE
from check_oracle import compare
from claimgeo.plans.bindings import TABLES, Bindings
from claimgeo.plans.catalog import ORACLE, QUERIES

from .conftest import SF001, SF01



@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = os.path.join(SF001, f"{t}.parquet")
        c.execute(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    line, ok = compare(spark, con, name, QUERIES[name], ORACLE.get(name), SF001)
    assert ok, line


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    from claimgeo.plans import bindings as B
    root = str(tmp_path_factory.mktemp("landed"))
    Bindings(spark, SF001).land(root)
    yield
    B.LANDED.pop(SF001.rstrip("/"), None)


@pytest.mark.parametrize("name", HEADLINE)
def test_benched_query_matches_oracle_on_landed_inputs(spark, con, landed, name):
    line, ok = compare(spark, con, name, QUERIES[name], ORACLE[name], SF001)
    assert ok, line


def test_every_query_but_non_sql_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["key", "period", "category", "total_beneficiaries_served", "total_claims",
                          "total_amount_paid"]
    assert df.count() > 0


@pytest.mark.parametrize("sf,expect", [
    (SF001, (6000, 5872, 3524, 548, 5, 63, 63)),
    (SF01, (60000, 58783, 41633, 6319, 47, 672, 637)),
])
def test_fixture_counts(spark, sf, expect):
    b = Bindings(spark, sf)
    got = (b.claims.count(), b.dental.count(), b.merged.count(), b.snapshots.count(), b.geocoded.count(),
           b.survey.count(), b.enroll_county.count())
    assert got == expect
