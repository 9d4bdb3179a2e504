"""Region values and the two exports, on the reference's unit-test inputs
(FIXTURES §1.1–1.3)."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from claimgeo.operators import export as E
from claimgeo.operators import rates as R
from claimgeo.sources.sinks import write_csv

AGG_SCHEMA = ("key string, period string, category string, total_beneficiaries_served bigint, "
              "total_claims bigint, total_amount_paid decimal(38,2)")
DENOM_SCHEMA = "region_id string, year string, medicaid_enrollees bigint"


def _agg(spark, rows):
    from decimal import Decimal
    return spark.createDataFrame([(*r[:-1], Decimal(r[-1])) for r in rows], AGG_SCHEMA)


@pytest.fixture(scope="module")
def one_region(spark):
    rows = [("X", "2023", "Preventive", 100, 500, 12500), ("X", "2023", "Diagnostic", 80, 300, 7500),
            ("X", "2022", "Preventive", 90, 400, 10000)]
    return _agg(spark, rows)


@pytest.fixture(scope="module")
def annual(spark):
    rows = [("CA", "2024", "Preventive", 80, 100, 5000), ("CA", "2024", "Restorative", 40, 50, 7500),
            ("CA", "2023", "Preventive", 150, 200, 9000), ("AL", "2024", "Preventive", 9, 10, 600),
            ("DC", "2024", "Restorative", 0, 0, 0)]
    return _agg(spark, rows)


@pytest.fixture(scope="module")
def denom(spark):
    return spark.createDataFrame([("CA", "2024", 1000), ("CA", "2023", 800)], DENOM_SCHEMA)


def _value(spark, agg, period, layer):
    rows = R.region_value(agg, period=period, layer=layer).collect()
    return {r.key: r.value for r in rows}


def test_region_value_cases(spark, one_region):
    assert _value(spark, one_region, "2023", "all") == {"X": 800}
    assert _value(spark, one_region, "2022", "all") == {"X": 400}
    assert _value(spark, one_region, "2023", "preventive") == {"X": 500}
    assert _value(spark, one_region, "2023", "diagnostic") == {"X": 300}
    assert _value(spark, one_region, "2099", "all") == {"X": 0}
    assert _value(spark, one_region, "2022", "diagnostic") == {"X": 0}
    empty = spark.createDataFrame([], AGG_SCHEMA)
    uni = spark.createDataFrame([("X",)], "key string")
    rows = R.region_value(empty, period="2023", layer="all", universe=uni).collect()
    assert [(r.key, r.value) for r in rows] == [("X", 0.0)]


def test_rate_is_null_without_denominator(spark, one_region):
    d = spark.createDataFrame([("X", "2023", 0)], DENOM_SCHEMA)
    rows = R.region_value(one_region, period="2023", layer="all", metric="enrollees", denom=d).collect()
    assert rows[0].value is None
    d = spark.createDataFrame([("X", "2023", 1000)], DENOM_SCHEMA)
    rows = R.region_value(one_region, period="2099", layer="all", metric="enrollees", denom=d).collect()
    assert rows[0].value is None          # no denominator for 2099 (D11)


def test_view_export(spark, annual):
    out = E.view_export(annual, "state", "2024", "all")
    assert out.columns == E.VIEW_COLUMNS
    rows = out.collect()
    assert [r.region_id for r in rows] == ["AL", "CA"]          # DC (all zero) dropped, sorted
    ca = rows[1]
    assert (ca.total_claims, ca.total_beneficiaries_served, float(ca.total_amount_paid)) == (150, 120, 12500.0)
    assert ca.category == "All Categories" and ca.region_name == "California" and ca.level == "state"
    rows = E.view_export(annual, "state", "2024", "preventive").collect()
    assert {r.region_id: r.total_claims for r in rows} == {"AL": 10, "CA": 100}
    rows = E.view_export(annual, "state", "2023", "all").collect()
    assert [(r.region_id, r.total_claims) for r in rows] == [("CA", 200)]
    rows = E.view_export(annual, "zip3", "2024", "all").collect()
    assert rows[0].region_name == "ZIP3 AL"


def test_subset_export(spark, annual, denom):
    out = E.subset_export(annual, "state", denom, periods=["2023", "2024"],
                          categories=["preventive", "restorative"], regions=["CA", "AL"])
    assert out.columns == E.SUBSET_COLUMNS
    rows = out.collect()
    assert [(r.region_id, r.period, r.category) for r in rows] == [
        ("AL", "2024", "Preventive"), ("CA", "2023", "Preventive"),
        ("CA", "2024", "Preventive"), ("CA", "2024", "Restorative")]
    ca = rows[2]
    assert ca.medicaid_enrollees == 1000 and ca.claims_per_enrollee == 0.1
    assert rows[0].medicaid_enrollees is None and rows[0].claims_per_enrollee is None
    dc = E.subset_export(annual, "state", denom, periods=["2024"], categories=["restorative"], regions=["DC"])
    assert dc.count() == 0
    sel = spark.createDataFrame([("CA",)], "r string")        # a selection given as a DataFrame
    rows = E.subset_export(annual, "state", denom, periods=["2024"], categories=["preventive"],
                           regions=sel, include_all=True).collect()
    allrow = [r for r in rows if r.category == "All Categories"][0]
    assert allrow.total_claims == 150 and float(allrow.total_amount_paid) == 12500.0
    assert allrow.claims_per_enrollee == 0.15


def test_monthly_and_periods(spark, denom):
    rows = [("CA", "2024-06", "Preventive", 10, 12, 500), ("CA", "2024-07", "Preventive", 12, 15, 600)]
    monthly = _agg(spark, rows)
    out = E.view_export(monthly, "state", "2024-06", "all").collect()
    assert [(r.year, r.total_claims) for r in out] == [("2024-06", 12)]
    sub = E.subset_export(monthly, "state", denom, periods=["2024-06"], categories=["preventive"]).collect()
    assert sub[0].claims_per_enrollee == 0.012 and sub[0].medicaid_enrollees == 1000
    assert [r.period for r in E.available_periods(monthly).collect()] == ["2024-06", "2024-07"]


def test_estimate(spark):
    assert E.estimate_value(3, 5, 2, False) == 30
    assert E.estimate_value(3, 5, 2, True) == 45
    r = spark.createDataFrame([(x,) for x in "abc"], "k string")
    p = spark.createDataFrame([(x,) for x in "12345"], "p string")
    row = E.estimate_rows(r, p, 2, True).collect()[0]
    assert row.estimated_rows == 45 and row.over_cap is False
    row = E.estimate_rows(r, p, 2, True, cap=40).collect()[0]
    assert row.over_cap is True


def test_csv_quotes_comma_labels(spark):
    df = spark.createDataFrame([("06037", "Los Angeles County, CA", None)], "region_id string, region_name string, "
                                                                             "claims_per_enrollee double")
    d = tempfile.mkdtemp(prefix="claimgeo-csv-", dir="/tmp")
    path = os.path.join(d, "out")
    write_csv(df, path, ["region_id", "region_name", "claims_per_enrollee"], ["region_id"])
    text = "".join(open(os.path.join(path, f)).read() for f in sorted(os.listdir(path)) if f.endswith(".csv"))
    assert text.splitlines()[0] == "region_id,region_name,claims_per_enrollee"
    assert '"Los Angeles County, CA"' in text
    assert text.splitlines()[1].endswith(",")             # NULL rate written as an empty field


def test_search_regions(spark):
    dim = spark.createDataFrame([("NY", "New York"), ("NJ", "New Jersey"), ("CA", "California")],
                                "region_id string, region_name string")
    rows = E.search_regions(dim, "  NEW ").collect()
    assert [r.region_id for r in rows] == ["NJ", "NY"] and rows[0].n_matches == 2
    rows = E.search_regions(dim, "", limit=2).collect()
    assert len(rows) == 2 and rows[0].n_matches == 3
    rows = E.search_regions(dim, "c%").collect()     # literal substring, not LIKE
    assert rows == []


def test_category_ranking(spark, annual):
    rows = R.category_ranking(annual).filter(F.col("key") == "CA").filter(F.col("period") == "2024").collect()
    rows = sorted(rows, key=lambda r: r["rank"])
    assert [(r.category, r["rank"], r.bar_pct) for r in rows] == [("Preventive", 1, 100.0), ("Restorative", 2, 50.0)]
    dc = R.category_ranking(annual).filter(F.col("key") == "DC").collect()[0]
    assert dc.bar_pct == 0.0                     # max(claims, 1) guards the zero region
