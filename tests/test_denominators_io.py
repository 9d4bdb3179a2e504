"""Denominator sources and roll-ups (S9, S10, S12, S13, A19, J4) and the
id-cache / missing-month helpers (K9, I3)."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from claimgeo.operators import aggregate as A
from claimgeo.operators import denominators as D
from claimgeo.sources import readers as RD
from claimgeo.sources import sinks as SK


def scratch():
    return tempfile.mkdtemp(prefix="claimgeo-test-", dir="/tmp")


def test_read_enrollment_pads_and_keeps_null(spark):
    d = scratch()
    p = os.path.join(d, "county.csv")
    with open(p, "w") as fh:
        fh.write("geoid,year,medicaid_enrollees\n1001,2020,500\n06037,2020,\n 36061 ,2021,7\n")
    rows = {r.region_id: r.medicaid_enrollees for r in D.read_enrollment(spark, p).collect()}
    assert rows == {"01001": 500, "06037": None, "36061": 7}
    rows = {r.region_id: r.medicaid_enrollees for r in D.read_enrollment(spark, p, null_as_zero=True).collect()}
    assert rows["06037"] == 0


def test_enrollment_rollups_and_strict_parent(spark):
    df = spark.createDataFrame([("01001", "2020", 5), ("01003", "2020", 7), ("99001", "2020", 1),
                                ("02139", "2020", 3)], "region_id string, year string, medicaid_enrollees bigint")
    fips = A.fips_dimension(spark)
    st = {r.region_id: r.medicaid_enrollees for r in D.enrollment_by(df, "state", fips, strict=False).collect()}
    assert st == {"AL": 12, "AK": 3, "99": 1}
    with pytest.raises(ValueError, match="99"):
        D.enrollment_by(df, "state", fips)
    z3 = {r.region_id: r.medicaid_enrollees for r in D.enrollment_by(df, "zip3").collect()}
    assert z3 == {"010": 12, "990": 1, "021": 3}


def test_matrix_to_table(spark):
    doc = json.dumps([["NAME", "C27007_004E", "state", "county"], ["A County", "12", "01", "001"],
                      ["B County", "-666666666", "06", "037"]])
    other = json.dumps([["county", "NAME", "state", "C27007_004E"], ["003", "C County", "02", "7"]])
    t = D.matrix_to_table(spark.createDataFrame([(doc,), (other,)], "value string"), ["NAME", "C27007_004E", "state"])
    assert [tuple(r) for r in t.orderBy("NAME").collect()] == [
        ("A County", "12", "01"), ("B County", "-666666666", "06"), ("C County", "7", "02")]
    with pytest.raises(Exception, match="without column zip"):
        D.matrix_to_table(spark.createDataFrame([(doc,)], "value string"), ["zip"]).collect()


def test_read_or_empty_and_region_names(spark):
    schema = StructType([StructField("region_id", StringType()), StructField("year", StringType()),
                         StructField("medicaid_enrollees", LongType())])
    empty = D.read_or_empty(spark, "/tmp/claimgeo-does-not-exist/x.parquet", schema)
    assert empty.count() == 0 and empty.schema == schema
    d = scratch()
    gj = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "id": "01001", "properties": {"GEOID": "01001", "name": "Autauga"}},
        {"type": "Feature", "id": "01003", "properties": {"GEOID": "01003", "name": "Baldwin"}}]}
    p = os.path.join(d, "counties.geojson")
    with open(p, "w") as fh:
        json.dump(gj, fh)
    names = {r.region_id: r.name for r in RD.read_region_names(spark, p).collect()}
    assert names == {"01001": "Autauga", "01003": "Baldwin"}


def test_id_cache_and_missing_months(spark):
    snaps = spark.createDataFrame([("1", "201801"), (None, "201801"), ("2", "201802")], "npi string, ym string")
    d = scratch()
    SK.write_id_cache(snaps, os.path.join(d, "ids"))
    back = spark.read.parquet(os.path.join(d, "ids"))
    assert back.count() == 2                                   # NULL ids dropped (F2)
    wanted = spark.createDataFrame([("201801",), ("201802",), ("201803",)], "ym string")
    missing = [r.ym for r in SK.missing_months(wanted, os.path.join(d, "ids")).collect()]
    assert [str(m) for m in missing] == ["201803"]
    none_yet = SK.missing_months(wanted, os.path.join(d, "nothing"))
    assert none_yet.count() == 3


def test_additivity_invariant_detects_a_change(spark):
    base = spark.createDataFrame(
        [("01001", "AL", "2020-01", "2020", "Preventive", 1, 2, 3), ("01003", "AL", "2020-02", "2020", "Preventive", 1, 2, 3)],
        "county_fips string, state string, year_month string, year string, category string, benef bigint, "
        "claims bigint, paid bigint").withColumn("paid", F.col("paid").cast("decimal(18,2)"))
    county = A.category_aggregate(base, "county_fips", "year")
    state = A.category_aggregate(base, "state", "year")
    fine = A.attach_parent(county, "key", A.fips_dimension(spark), alias="parent").drop("key") \
        .withColumnRenamed("parent", "key")
    assert A.check_additive(fine, state, ["key", "period", "category"]).count() == 0
    broken = state.withColumn("total_claims", F.col("total_claims") + 1)
    assert A.check_additive(fine, broken, ["key", "period", "category"]).count() == 1


def test_output_invariants_find_repeats_and_differences(spark):
    rows = [("year", "state", "AL", "2020", "P", 3, 4, 5), ("year_month", "state", "AL", "2020-01", "P", 1, 2, 2),
            ("year_month", "state", "AL", "2020-02", "P", 2, 2, 3)]
    schema = ("grain string, level string, key string, period string, category string, total_beneficiaries_served bigint, "
              "total_claims bigint, total_amount_paid decimal(38,2)")
    from decimal import Decimal

    def bad(extra):
        df = spark.createDataFrame([(*r[:-1], Decimal(r[-1])) for r in rows + extra], schema)
        return {r.check: r.n_bad for r in A.output_invariants(df).collect()}
    assert bad([]) == {"grain_unique": 0, "annual_is_months": 0}
    assert bad([rows[1]]) == {"grain_unique": 1, "annual_is_months": 1}
    assert bad([("year_month", "state", "CA", "2020-01", "P", 1, 2, 2)]) == {"grain_unique": 0, "annual_is_months": 1}


def test_gate_without_row_counts(spark):
    from claimgeo.operators import geocode as G
    seen = spark.createDataFrame([("a", 3)], "address_id string, n_claim_rows bigint")
    geo = spark.createDataFrame([("a", "M", 1.0, 2.0)], "address_id string, geocode_status string, latitude double, longitude double")
    assert {r.check: r.ok for r in G.geocode_gate(seen, geo).collect()} == {
        "unused_geocoded": True, "join_miss_rows": True, "unexpected_missing_rows": True, "all_checks": True}


def test_share_names_prefix_filter_and_report(spark):
    from claimgeo.operators import export as E
    from claimgeo.operators import quality as Q
    from claimgeo.operators import snapshot as S
    rep = spark.createDataFrame([("a", 1, 3), ("b", 3, 1)], "bucket string, rows bigint, claims bigint")
    got = {r.bucket: (r.rows_pct, r.claims_pct) for r in Q.share_of_total(rep, ["rows", "claims"]).collect()}
    assert got == {"a": (25.0, 75.0), "b": (75.0, 25.0)}
    df = spark.createDataFrame([("06037",), ("01001",), ("99999",)], "region_id string")
    dim = spark.createDataFrame([("06037", "Los Angeles County, CA")], "region_id string, name string")
    names = {r.region_id: r.region_name for r in E.attach_names(df, "county", dim).collect()}
    assert names == {"06037": "Los Angeles County, CA", "01001": "01001", "99999": "99999"}
    st = spark.createDataFrame([("CA",), ("ZZ",)], "region_id string")
    assert {r.region_id: r.region_name for r in E.attach_names(st, "state").collect()} == \
        {"CA": "California", "ZZ": "ZZ"}
    codes = spark.createDataFrame([("D1110",), ("99213",), (None,)], "code string")
    assert [r.code for r in S.filter_code_prefix(codes).collect()] == ["D1110"]
    d = scratch()
    SK.write_report(rep, os.path.join(d, "rep"), ["rows"])
    files = sorted(f for f in os.listdir(os.path.join(d, "rep")) if f.endswith(".csv"))
    lines = [x for f in files for x in open(os.path.join(d, "rep", f)).read().splitlines()]
    assert [x for x in lines if x != "bucket,rows,claims"] == ["a,1,3", "b,3,1"]


def test_write_all_outputs_matches_output_counts(spark):
    import __spark_entry__ as E
    from claimgeo.plans.q_aggregate import base
    from .conftest import SF001
    d = scratch()
    got = {r.output: (r.n_keys, r.n_records) for r in SK.write_all_outputs(base(spark, SF001), d).collect()}
    exp = {r.output: (r.n_keys, r.n_records) for r in E.queries()["output_counts"](spark, SF001).collect()}
    assert got == exp and len(got) == 6
    back = RD.read_keyed_ndjson(spark, os.path.join(d, "monthly_county"), period_field="year_month")
    assert back.count() == exp["monthly_county"][1]
