"""Joins without raw-row shuffles or per-row hashing: bucketed tables (J1), the
address dictionary (J2) and the one-pass waterfall (A13)."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from claimgeo.operators import address as AD
from claimgeo.operators import geocode as G
from claimgeo.operators import quality as Q
from claimgeo.operators import snapshot as S
from claimgeo.plans.catalog import QUERIES, bind  # fills the registry, bindings come after
from claimgeo.plans import bindings
from claimgeo.plans.bindings import Bindings
from claimgeo.plans.q_sources import bucketed_inputs
from claimgeo.session import room_for
from claimgeo.sources import bucketed as B

from .conftest import SF001


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(tuple(str(v) for v in r) for r in df.collect())


@pytest.fixture()
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_bucketed_join_has_no_exchange(spark, no_broadcast):
    claims, registry = bucketed_inputs(spark, SF001)
    j = B.bucketed_snapshot_join(S.filter_code_prefix(claims), registry)
    p = plan(j)
    assert "SortMergeJoin" in p and "Exchange" not in p and p.count("Bucketed: true") == 2
    b = bind(spark, SF001)
    assert rows(j.select("servicing_id", "year_month", "claims", "zip5")) == \
        rows(b.merged.select("servicing_id", "year_month", "claims", F.col("practice_zip5")))


def test_ids_that_no_registry_holds_stay_out(spark):
    ids = ["1234567890", "0000000000", "9999999999", "A000000001", "11014123A", "123456789", None, "1234567890\n", "0000000001"]
    df = spark.createDataFrame([(x,) for x in ids], "servicing_id string")
    assert [r[0] for r in df.select(B.is_matchable("servicing_id")).collect()] == [True] + [False] * 7 + [True]
    claims = spark.createDataFrame([("0000000000", "2020-01")] * 50 + [("1234567890", "2020-01")], "servicing_id string, year_month string")
    snaps = spark.createDataFrame([("1234567890", "2020-01", 1), ("1234567890", "2020-02", 2)], "npi string, ym string, v int")
    assert [r.v for r in B.bucketed_snapshot_join(claims, snaps).collect()] == [1]


def test_a_bucketed_table_is_attached_from_its_folder(spark, no_broadcast):
    path = os.path.join(tempfile.mkdtemp(prefix="claimgeo-bucketed-", dir="/tmp"), "t")
    df = spark.createDataFrame([(f"{i:010d}", f"2020-0{1 + i % 3}", i) for i in range(300)], "id string, ym string, v long")
    B.write_bucketed(df, "written_here", path, "id", "ym", 4)
    again = B.attach_bucketed(spark, "found_there", path, "id STRING, v BIGINT, ym STRING", "id", "ym", 4)
    assert rows(again.select("id", "ym", "v")) == rows(df)
    assert "Exchange" not in plan(again.groupBy("id").agg(F.sum("v")))
    assert [r.v for r in again.filter("ym = '2020-02' AND id = '0000000004'").collect()] == [4]


def test_buckets_for():
    assert B.buckets_for(1) == 1 and B.buckets_for(3 * 256 * 1024 ** 2) == 4
    assert B.buckets_for(100 * 1024 ** 4, 84) == 8192


def test_dictionary_join_equals_the_row_join(spark):
    b = bind(spark, SF001)
    want = G.geocode_join(G.with_address_id(b.merged, AD.ADDRESS_PARTS), b.geocoded)
    for n in (1_000_000, 3):                                       # nothing hot, nearly everything hot
        got = G.geocode_join_by_dictionary(b.merged, b.geocoded, AD.ADDRESS_PARTS, rows_per_task=n)
        assert set(got.columns) == set(want.columns)
        assert rows(got.select(sorted(got.columns))) == rows(want.select(sorted(want.columns)))


def hot_claims(spark, n=3000):
    parts = ["l1", "l2"]
    claims = spark.range(n).select(
        "id", F.when(F.col("id") % 3 == 0, "1 main  st").otherwise(F.concat(F.col("id") % 200, F.lit(" Oak"))).alias("l1"),
        F.when(F.col("id") % 2 == 0, F.lit("")).alias("l2"))
    geo = G.with_address_id(spark.createDataFrame([("1 MAIN ST", "")], "l1 string, l2 string"), parts).select(
        "address_id", F.lit("M").alias("geocode_status"), F.lit("01001").alias("county_fips"), F.lit("c").alias("county_name"),
        F.lit(1.0).alias("latitude"), F.lit(2.0).alias("longitude"))
    return claims, spark.createDataFrame(geo.collect(), geo.schema), parts


def test_an_address_with_a_third_of_the_rows_is_split(spark, no_broadcast):
    claims, geo, parts = hot_claims(spark)
    got = G.geocode_join_by_dictionary(claims, geo, parts, rows_per_task=100)
    assert got.count() == 3000 and got.filter("geocode_status = 'M'").count() == 1000
    assert got.filter("geocode_status = 'M' AND id % 3 <> 0").count() == 0
    assert got.select("id").distinct().count() == 3000
    # 500 rows with l2 NULL and 500 with '': both spellings hold more than 100 rows and are dealt over five parts
    words = G.raw_addresses(claims, parts)
    assert {r.n_rows_seen for r in words.filter("l1 = '1 main  st'").collect()} == {500}


def test_no_regex_or_hash_of_addresses_over_claim_rows(spark):
    claims, geo, parts = hot_claims(spark)
    p = G.geocode_join_by_dictionary(claims, geo, parts)._jdf.queryExecution().optimizedPlan().toString()
    lines = p.splitlines()
    for i, line in enumerate(lines):
        if "md5(" in line or "regexp_replace(" in line:              # what it reads is the aggregate
            below = [x.strip(" :+-") for x in lines[i + 1:i + 4]]
            assert any(x.startswith(("Aggregate", "Filter")) for x in below), line
    assert "md5(" in p


def test_waterfall_reads_each_side_once(spark, tmp_path_factory):
    from claimgeo.plans import bindings as BD
    key = SF001.rstrip("/")
    try:
        bind(spark, SF001).land(str(tmp_path_factory.mktemp("landed")))
        p = plan(QUERIES["loss_waterfall"](spark, SF001))
    finally:
        BD.LANDED.pop(key, None)
    scans = [x for x in p.splitlines() if "FileScan parquet" in x]
    assert sum("/claims" in x for x in scans) == 1
    assert "SortMergeJoin" not in p.split("HashAggregate")[0]


def test_waterfall_with_repeated_registry_rows_and_unknown_ids(spark):
    claims = spark.createDataFrame([("1", "2020-01", "D1")] * 3 + [("1", "2020-02", "D1"), ("2", "2020-01", "X")] + [(None, "2020-01", "D2")] * 4,
                                   "servicing_id string, year_month string, code string")
    registry = spark.createDataFrame([("1", "2020-01", 1.0, 2.0), ("1", "2020-01", None, 2.0), ("2", "2020-01", 1.0, 1.0), (None, "2020-01", 1.0, 1.0)],
                                     "npi string, ym string, latitude double, longitude double")
    got = [(r.stage, r.rows, r.dropped) for r in Q.loss_waterfall_once(claims, registry, F.col("code").startswith("D"), G.located())
           .orderBy("stage_no").collect()]
    assert got == [("source", 9, 0), ("code_filter", 8, 1), ("snapshot_join", 6, 2), ("geocoded", 3, 3)]
    empty = Q.loss_waterfall_once(claims.limit(0), registry, F.col("code").startswith("D"), G.located()).collect()
    assert [(r.rows, r.dropped, r.dropped_pct) for r in empty] == [(0, 0, 0.0)] * 4


def test_buckets_follow_the_rows(spark):
    assert [B.buckets_for_rows(n) for n in (0, 8_000_000, 8_000_001, 240_000_000)] == [4, 4, 8, 128]
    claims, _ = bucketed_inputs(spark, SF001, rows_a_bucket=400)
    assert len({f.rsplit("_", 1)[1].split(".")[0] for f in claims.inputFiles()}) > 4


def test_the_shuffle_partitions_follow_the_rows(spark):
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    try:
        assert room_for(spark, 10) == int(before) and spark.conf.get(name) == before
        assert room_for(spark, 10_000_001) == 21 and spark.conf.get(name) == "21"
        assert room_for(spark, 10) == 21                       # never lowered
    finally:
        spark.conf.set(name, before)


def test_providers_are_dealt_over_tasks_before_they_become_months(spark, monkeypatch):
    want = sorted(map(tuple, Bindings(spark, SF001).snapshots.collect()))
    monkeypatch.setattr(bindings, "PROVIDERS_A_TASK", 3)
    dealt = Bindings(spark, SF001).snapshots
    assert "REPARTITION_BY_NUM" in plan(dealt) and sorted(map(tuple, dealt.collect())) == want
