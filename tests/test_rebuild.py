"""Manifest of finished months, forced rebuilds, segmented line simplification."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimgeo.operators import geometry as GM
from claimgeo.sources import readers as RD
from claimgeo.sources import sinks as SK
from claimgeo.streaming import incremental as I

from .test_denominators_io import scratch

SCHEMA = "k string, n long, ym string"


def _sums(df):
    return df.groupBy("ym").agg(F.sum("n").alias("n"))


def _paths():
    d = scratch()
    return [os.path.join(d, p) for p in ("src", "dst", "checkpoint", "manifest")]


def _arrive(spark, rows, src):
    SK.write_by_month(spark.createDataFrame(rows, SCHEMA), src, mode="append")


def _read(spark, dst):
    return {r.ym: r.n for r in spark.read.schema("n long, ym string").parquet(dst).collect()}


def test_only_months_with_other_files_are_built(spark):
    src, dst, ck, manifest = _paths()
    schema = spark.createDataFrame([], SCHEMA).schema
    _arrive(spark, [("a", 1, "2020-01"), ("b", 2, "2020-02")], src)
    assert I.finished_months(spark, manifest).count() == 0
    I.run_incremental(spark, src, dst, ck, schema, _sums, manifest=manifest)
    assert sorted(r.ym for r in I.finished_months(spark, manifest).collect()) == ["2020-01", "2020-02"]
    assert I.build_months(spark, src, dst, manifest, schema, _sums) == []
    _arrive(spark, [("c", 5, "2020-02"), ("d", 7, "2020-03")], src)
    assert I.build_months(spark, src, dst, manifest, schema, _sums, months=["2020-03", "2031-01"]) == ["2020-03"]
    assert I.build_months(spark, src, dst, manifest, schema, _sums) == ["2020-02"]
    assert _read(spark, dst) == {"2020-01": 1, "2020-02": 7, "2020-03": 7}
    # The stream comes to the late files after the build: same result.
    I.run_incremental(spark, src, dst, ck, schema, _sums, manifest=manifest)
    assert _read(spark, dst) == {"2020-01": 1, "2020-02": 7, "2020-03": 7}
    made = {r.ym: (r.n_files, r.made_by) for r in I.finished_months(spark, manifest).collect()}
    assert made["2020-01"] == (1, "batch 0") and made["2020-02"] == (2, "batch 1")


def test_a_month_that_died_before_it_was_listed_is_built_again(spark, monkeypatch):
    src, dst, ck, manifest = _paths()
    schema = spark.createDataFrame([], SCHEMA).schema
    _arrive(spark, [("a", 1, "2020-01")], src)
    write = I.write_by_month

    def dies(df, path, *rest):
        if path == manifest:
            raise OSError("lost")
        write(df, path, *rest)
    monkeypatch.setattr(I, "write_by_month", dies)
    with pytest.raises(Exception, match="lost"):
        I.run_incremental(spark, src, dst, ck, schema, _sums, manifest=manifest)
    monkeypatch.setattr(I, "write_by_month", write)
    assert [r.ym for r in I.stale_months(spark, src, manifest).collect()] == ["2020-01"]
    I.run_incremental(spark, src, dst, ck, schema, _sums, manifest=manifest)
    assert _read(spark, dst) == {"2020-01": 1} and I.stale_months(spark, src, manifest).count() == 0


def test_force_builds_what_is_finished(spark):
    src, dst, _, manifest = _paths()
    schema = spark.createDataFrame([], SCHEMA).schema
    _arrive(spark, [("a", 1, "2020-01"), ("b", 2, "2020-02")], src)
    assert I.build_months(spark, src, dst, manifest, schema, _sums) == ["2020-01", "2020-02"]
    SK.write_by_month(spark.createDataFrame([(99, "2020-01"), (99, "2020-02")], "n long, ym string"), dst)
    assert I.build_months(spark, src, dst, manifest, schema, _sums, months=["2020-02"], force=True) == ["2020-02"]
    assert _read(spark, dst) == {"2020-01": 99, "2020-02": 2}


def test_missing_months_opens_no_file(spark):
    d = scratch()
    os.makedirs(os.path.join(d, "ids", "ym=2020-01"))
    with open(os.path.join(d, "ids", "ym=2020-01", "part-0.parquet"), "w") as fh:
        fh.write("no parquet at all")
    wanted = spark.createDataFrame([("2020-01",), ("2020-02",)], "ym string")
    assert [r.ym for r in SK.missing_months(wanted, os.path.join(d, "ids")).collect()] == ["2020-02"]


def test_registry_files_of_many_headers(spark):
    """Two headers over many files, a blank first line and an empty file."""
    d = scratch()
    os.makedirs(d, exist_ok=True)
    for i in range(30):
        with open(os.path.join(d, f"npi_raw_2020{i % 12 + 1:02d}_{i}.csv"), "w") as fh:
            fh.write(("\n" if i == 4 else "") + ("NPI,City\n" if i % 2 else "City,NPI\n") + (f"{i},x\n" if i % 2 else f"x,{i}\n"))
    open(os.path.join(d, "npi_raw_202101_0.csv"), "w").close()
    got = RD.read_snapshots(spark, f"{d}/*.csv", r"npi_raw_(\d{6})").select("NPI", "City", "ym").collect()
    assert sorted((int(r.NPI), r.City, r.ym) for r in got) == [(i, "x", f"2020{i % 12 + 1:02d}") for i in range(30)]


def _plain(points, tol):
    """Douglas-Peucker by the definition: the kept numbers of an open line."""
    if len(points) < 3:
        return set(range(len(points)))
    a, b = points[0], points[-1]
    chord = b - a
    length = np.hypot(*chord)
    away = [abs(chord[1] * (p - a)[0] - chord[0] * (p - a)[1]) / length if length > 0 else np.hypot(*(p - a)) for p in points[1:-1]]
    k = int(np.argmax(away)) + 1
    if away[k - 1] <= tol:
        return {0, len(points) - 1}
    return _plain(points[:k + 1], tol) | {k + i for i in _plain(points[k:], tol)}


def test_segmented_simplification_is_the_plain_one():
    rng = np.random.default_rng(3)
    lines = [rng.integers(0, 6, (int(n), 2)).astype(float) for n in rng.integers(2, 60, 200)]
    keep = np.concatenate([np.isin(np.arange(len(x)), [0, len(x) - 1]) for x in lines])
    for tol in (0.0, 0.5, 1.5, 9.0):
        got = GM.refine_lines(np.concatenate(lines), keep, tol)
        at = 0
        for x in lines:
            assert set(np.flatnonzero(got[at:at + len(x)])) == _plain(x, tol)
            at += len(x)
