"""Quantile stops / colour classes and the id-set operators, each against a
small brute-force implementation of the stated rule."""

import math
import random

from pyspark.sql import functions as F

from claimgeo.functions import constants as K
from claimgeo.operators import classify as C
from claimgeo.operators import quality as Q
from claimgeo.operators import snapshot as S


def brute_stops(values, metric):
    v = sorted(x for x in values if x is not None and x > 0)
    if not v:
        return list(K.DEFAULT_STOPS)
    qs = list(K.QUANTILES_BASE) + [K.TOP_CLIP[metric]]
    out = []
    for i, q in enumerate(qs):
        s = v[min(len(v) - 1, math.floor(q * len(v)))]
        if i > 0 and s <= out[-1]:
            s = out[-1] + K.MIN_GAP[metric]
        out.append(s)
    return out


def test_quantile_stops_match_rule(spark):
    rnd = random.Random(7)
    slices = {
        "empty": [0.0, -1.0, None],
        "one": [5.0],
        "equal": [3.0] * 10,
        "ties": [1.0, 1.0, 1.0, 2.0, 2.0, 9.0],
        "n25": [float(rnd.randint(1, 40)) for _ in range(25)],
        "n100": [float(rnd.randint(1, 1000)) for _ in range(100)],
        "n300": [rnd.random() * 100 for _ in range(300)],
        "mixed": [0.0, -3.0, None, 4.0, 2.0, 8.0],
    }
    rows = [(k, v) for k, vs in slices.items() for v in vs]
    df = spark.createDataFrame(rows, "s string, value double")
    for metric in ("claims", "enrollees"):
        got = {r.s: [r[f"s{i}"] for i in range(7)] for r in C.quantile_stops(df, ["s"], metric=metric).collect()}
        for k, vs in slices.items():
            exp = brute_stops(vs, metric)
            assert all(abs(a - b) < 1e-9 for a, b in zip(got[k], exp)), (metric, k, got[k], exp)
            assert all(b > a for a, b in zip(got[k], got[k][1:]))     # strictly ascending


def test_quantile_rule_is_not_percentile_disc(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (10, 20, 30, 40)], "s string, value double")
    r = C.quantile_stops(df, ["s"]).collect()[0]
    assert r.s3 == 30.0       # index floor(0.5 * 4) = 2 -> 30; percentile_disc(0.5) would give 20


def test_color_class(spark):
    vals = spark.createDataFrame([("a", v) for v in (None, 0.5, 1.0, 2.5, 7.0, 100.0)], "s string, value double")
    stops = spark.createDataFrame([("a", 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0)],
                                  "s string, s0 double, s1 double, s2 double, s3 double, s4 double, s5 double, "
                                  "s6 double")
    got = [(r.value, r.band, r.t, r.no_data) for r in C.color_class(vals, stops, ["s"]).collect()]
    got = sorted(got, key=lambda x: (x[0] is not None, x[0] or 0))
    assert got == [(None, None, 0.0, True), (0.5, 0, 0.0, False), (1.0, 0, 0.0, False),
                   (2.5, 1, 0.5, False), (7.0, 6, 0.0, False), (100.0, 6, 0.0, False)]


FACTS = [  # (servicing_id, year_month, claims)
    ("1", "2020-01", 1), ("1", "2020-01", 1), ("1", "2020-03", 1), ("2", "2020-02", 1),
    ("3", "2020-06", 1), (None, "2020-01", 1), ("4", "2020-01", 1), ("5", "2020-05", 1),
]
SNAPS = [  # (npi, ym) with a duplicated row for id 4
    ("1", "2020-02"), ("1", "2020-05"), ("2", "2020-02"), ("4", "2020-01"), ("4", "2020-01"),
    ("5", "2019-12"), ("5", "2020-10"),
]


def _mi(ym):
    return int(ym[:4]) * 12 + int(ym[5:7]) - 1


def test_id_sets_against_brute_force(spark):
    facts = spark.createDataFrame(FACTS, "servicing_id string, year_month string, claims bigint")
    snaps = spark.createDataFrame(SNAPS, "npi string, ym string")
    marked = S.mark_presence(S.id_months(facts), snaps)
    dropped = S.dropped_ids(marked)
    present = {(n, y) for n, y in SNAPS}
    exp_dropped = {}
    for sid, ym, _ in FACTS:
        if (sid, ym) not in present:
            exp_dropped[(sid, ym)] = exp_dropped.get((sid, ym), 0) + 1
    got = {(r.servicing_id, r.year_month): r.n_rows for r in dropped.collect()}
    assert got == exp_dropped

    rec = {(r.servicing_id, r.year_month) for r in S.recoverable(dropped, 1).collect()}
    exp = {k for k in exp_dropped if k[0] is not None
           and any(n == k[0] and abs(_mi(y) - _mi(k[1])) == 1 for n, y in SNAPS)}
    assert rec == exp

    near = {(r.servicing_id, r.year_month): (r.nearest_ym, r.distance) for r in S.nearest_month(dropped).collect()}
    for (sid, ym) in exp_dropped:
        if sid is None:
            continue
        cands = sorted({y for n, y in SNAPS if n == sid}, key=lambda y: (abs(_mi(y) - _mi(ym)), _mi(y)))
        want = (cands[0], abs(_mi(cands[0]) - _mi(ym))) if cands else (None, None)
        assert near[(sid, ym)] == want, (sid, ym)
    # id 1 in 2020-03: 2020-02 (distance 1) beats 2020-05; id 5 in 2020-05: tie 2019-12 vs 2020-10 -> earlier
    assert near[("1", "2020-03")] == ("2020-02", 1)
    assert near[("5", "2020-05")] == ("2019-12", 5)


def test_duplicate_snapshot_rows_hide_drops_only_in_the_delta(spark):
    """A repeated snapshot id multiplies merged rows; the anti join still counts true drops."""
    facts = spark.createDataFrame(FACTS, "servicing_id string, year_month string, claims bigint")
    snaps = spark.createDataFrame(SNAPS, "npi string, ym string")
    marked = S.mark_presence(S.id_months(facts), snaps)
    merged = S.snapshot_join(facts, snaps).groupBy("year_month").agg(F.count(F.lit(1)).alias("merged_rows"))
    rep = Q.coverage_report(marked).collect()
    jan = [r for r in rep if r.year_month == "202001"][0]
    assert jan.hhs_dental_rows == 4 and jan.merged_rows == 2      # id 4 matched twice
    assert jan.dropped_rows == 2 and jan.anti_rows == 3           # delta hides one drop, anti join does not
    by_month = {r.year_month: r.merged_rows for r in S.merged_rows_by_month(marked).collect()}
    assert by_month == {r.year_month: r.merged_rows for r in merged.collect()}


def test_stable_sample_independent_of_partitioning(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("k"))
    a = [r.k for r in S.stable_sample(df.repartition(7), "k", 5).collect()]
    b = [r.k for r in S.stable_sample(df.coalesce(1), "k", 5).collect()]
    assert a == b and len(a) == 5
