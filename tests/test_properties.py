"""Properties: results independent of the partition count; invariants hold
on the fixture; incremental equals batch (covered by the oracle test)."""

import pytest

import __spark_entry__ as E
from claimgeo.plans.catalog import QUERIES

from .conftest import SF001


def _rows(df):
    return sorted(tuple(str(v) for v in r) for r in df.collect())


def test_partition_count_does_not_change_results(spark):
    q = E.queries()
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        out = {}
        for n in ("1", "13"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            out[n] = {name: _rows(q[name](spark, SF001)) for name in
                      ("agg_monthly_county", "quantile_stops_claims", "nearest_month", "address_concentration")}
        assert out["1"] == out["13"]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_invariants_hold(spark):
    q = E.queries()
    for name in ("invariant_state_county", "invariant_annual_monthly"):
        r = q[name](spark, SF001).collect()[0]
        assert r.n_mismatch == 0 and r.ok


def test_merged_plus_anti_equals_dental_when_snapshots_unique(spark):
    r = E.queries()["coverage_total"](spark, SF001).collect()[0]
    rep = E.queries()["coverage_report"](spark, SF001)
    tot_anti = sum(x.anti_rows for x in rep.collect())
    assert r.merged_rows + tot_anti == r.hhs_dental_rows


def test_plans_have_no_cartesian_or_python_except_simplify(spark):
    bad = {}
    for name, fn in QUERIES.items():
        if name == "incremental_months":       # side-effecting streaming run, checked by the oracle test
            continue
        plan = fn(spark, SF001)._jdf.queryExecution().executedPlan().toString()
        hits = [k for k in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython",
                            "ArrowEvalPython", "MapInPandas", "MapInArrow") if k in plan]
        if hits:
            bad[name] = hits
    assert bad == {"simplify_rings": ["MapInArrow"]}


def test_filters_and_columns_reach_the_landed_scan(spark, tmp_path_factory):
    from claimgeo.plans import bindings as B
    root = str(tmp_path_factory.mktemp("landed"))
    try:
        B.Bindings(spark, SF001).land(root)
        plan = E.queries()["agg_annual_state"](spark, SF001)._jdf.queryExecution().executedPlan().toString()
        scan = [line for line in plan.splitlines() if "FileScan parquet" in line and "/claims" in line][0]
        assert "StringStartsWith(code,D)" in scan
        assert "ReadSchema: struct<servicing_id:string,code:string,benef:bigint,claims:bigint,paid:decimal(18,2)>" \
            in scan
    finally:
        B.LANDED.pop(SF001.rstrip("/"), None)


def test_size_for_input(spark):
    from claimgeo.session import size_for_input
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes",
                                          "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    try:
        conf = size_for_input(spark, 100 * 1024 ** 4)          # 100 TB
        assert conf["spark.sql.shuffle.partitions"] == str(100 * 1024 ** 4 // (256 * 1024 ** 2))
        assert size_for_input(spark, 10 * 1024 ** 3)["spark.sql.shuffle.partitions"] == "200"
        assert size_for_input(spark, 1024 ** 4)["spark.sql.shuffle.partitions"] == "4096"
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("name", ["coverage_report", "coverage_total", "drop_distance_buckets", "drop_verdict", "id_buckets",
                                  "nearest_month", "never_seen_ids", "dropped_ids"])
def test_coverage_family_reads_each_side_once(spark, tmp_path_factory, name):
    """One scan of the claims and one of the registry, and the claims reach
    the window over an id's months as (month, id) groups."""
    from claimgeo.plans import bindings as B
    key = SF001.rstrip("/")
    try:
        B.LANDED[key] = landed(spark, tmp_path_factory)
        plan = E.queries()[name](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    finally:
        B.LANDED.pop(key, None)
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line]
    assert sum("/claims" in line for line in scans) == 1 and sum("/snapshots" in line for line in scans) == 1
    window = plan.index("Window [")
    assert "functions=[count(1)" in plan[window:]              # printed below the window: evaluated before it
    assert "AntiJoin" not in plan and "LeftAnti" not in plan


_LANDED = {}


def landed(spark, tmp_path_factory):
    """The input roles of SF001, written once for these tests."""
    from claimgeo.plans import bindings as B
    if "root" not in _LANDED:
        _LANDED["root"] = str(tmp_path_factory.mktemp("landed-once"))
        B.Bindings(spark, SF001).land(_LANDED["root"])
        B.LANDED.pop(SF001.rstrip("/"), None)
    return _LANDED["root"]


def test_incremental_rebuild_names_its_months_to_the_scan(spark, tmp_path_factory):
    from claimgeo.plans.q_stream import INPUT_SCHEMA
    from claimgeo.sources.sinks import write_by_month
    from claimgeo.streaming.incremental import months_of, touched_months
    src = str(tmp_path_factory.mktemp("months"))
    rows = spark.createDataFrame([("1", f"2020-{m:02d}", m) for m in range(1, 13)], "servicing_id string, ym string, claims long")
    write_by_month(rows, src)
    assert touched_months(rows.filter("claims IN (3, 7)")) == ["2020-03", "2020-07"]
    df = months_of(spark, src, INPUT_SCHEMA, ["2020-03", "2020-07"])
    scan = [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in x][0]
    assert "PartitionFilters: [ym" in scan and "2020-03" in scan
    assert df.count() == 2 and df.select("ym").distinct().count() == 2
