"""Queries of the coverage / drop diagnosis, id buckets and colour classes
(J5–J7, J12, J13, U1, U2, A6–A12, Q3–Q5, Q7, Q8, O5, W1–W3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import aggregate as A
from ..operators import classify as C
from ..operators import denominators as D
from ..operators import quality as Q
from ..operators import rates as R
from ..operators import snapshot as S
from .catalog import bind, register
from .oracle_views import with_views
from .q_aggregate import base
from .q_rates import CELLS, MARGINS, survey

_MI = "(CAST(substr({c}, 1, 4) AS INTEGER) * 12 + CAST(substr({c}, 6, 2) AS INTEGER) - 1)"

ID_CTES = {
    "fb": f"""SELECT year_month, servicing_id, {_MI.format(c='year_month')} AS mi, count(*) AS n_rows,
                     sum(claims) AS claims, sum(paid) AS paid
              FROM v_dental GROUP BY ALL""",
    "dr": """SELECT * FROM fb WHERE NOT EXISTS
               (SELECT 1 FROM v_snapshots s WHERE s.npi = fb.servicing_id AND s.ym = fb.year_month)""",
    "rc": """SELECT * FROM dr WHERE EXISTS
               (SELECT 1 FROM v_snapshots s WHERE s.npi = dr.servicing_id
                 AND s.mi BETWEEN dr.mi - 1 AND dr.mi + 1 AND s.mi <> dr.mi)""",
    "nm": """SELECT d.year_month, d.servicing_id, d.n_rows,
                    (SELECT s.ym FROM v_snapshots s WHERE s.npi = d.servicing_id
                      ORDER BY abs(s.mi - d.mi), s.mi LIMIT 1) AS nearest_ym,
                    (SELECT CAST(min(abs(s.mi - d.mi)) AS INTEGER) FROM v_snapshots s
                      WHERE s.npi = d.servicing_id) AS distance
             FROM dr d WHERE d.servicing_id IS NOT NULL""",
}


def _ids(spark, sf):
    b = bind(spark, sf)
    marked = S.mark_presence(S.id_months(b.dental, measures=("claims", "paid")), b.snapshots)
    return b, marked, S.dropped_ids(marked)


@register("dropped_ids", with_views("SELECT year_month, servicing_id, CAST(n_rows AS BIGINT) AS n_rows FROM dr",
                                    ID_CTES))
def dropped_ids(spark, sf):
    """(month, id) groups with no same-month snapshot, with their rows."""
    return _ids(spark, sf)[2].select("year_month", "servicing_id", "n_rows")


@register("recovery_window", with_views("SELECT year_month, servicing_id, CAST(n_rows AS BIGINT) AS n_rows FROM rc",
                                        ID_CTES))
def recovery_window(spark, sf):
    """Dropped groups whose id is present within ±1 month."""
    return S.recoverable(_ids(spark, sf)[2], 1).select("year_month", "servicing_id", "n_rows")


@register("nearest_month", with_views(
    "SELECT year_month, servicing_id, CAST(n_rows AS BIGINT) AS n_rows, nearest_ym, distance FROM nm", ID_CTES))
def nearest_month(spark, sf):
    """Closest month with the id present, for every dropped group."""
    return S.nearest_month(_ids(spark, sf)[2])


@register("month_coverage", with_views("""
SELECT coalesce(c.ym, s.ym) AS ym, c.ym IS NOT NULL AS in_claims, s.ym IS NOT NULL AS in_snapshots,
       CASE WHEN c.ym IS NOT NULL AND s.ym IS NOT NULL THEN 'both'
            WHEN c.ym IS NOT NULL THEN 'claims_only' ELSE 'snapshot_only' END AS status
FROM (SELECT DISTINCT year_month AS ym FROM v_dental) c
FULL JOIN (SELECT DISTINCT ym FROM v_snapshots) s ON c.ym = s.ym"""))
def month_coverage(spark, sf):
    """Months with claims, snapshots, or both."""
    b = bind(spark, sf)
    return S.month_coverage(b.dental.select("year_month"), b.snapshots.select("ym"))


@register("ever_seen_ids", with_views("SELECT DISTINCT npi FROM v_snapshots"))
def ever_seen_ids(spark, sf):
    """Every id present in any snapshot month."""
    return S.ever_seen(bind(spark, sf).snapshots)


@register("never_seen_ids", with_views("""
SELECT DISTINCT servicing_id FROM dr WHERE servicing_id IS NOT NULL
EXCEPT SELECT npi FROM v_snapshots""", ID_CTES))
def never_seen_ids(spark, sf):
    """Dropped ids that no snapshot month contains."""
    dr = _ids(spark, sf)[2]
    return dr.filter(F.col("servicing_id").isNotNull() & ~F.col("in_any_month")).select("servicing_id").distinct()


_COV_SQL = """
SELECT replace(t.year_month, '-', '') AS year_month,
       CAST(t.n AS BIGINT) AS hhs_dental_rows, CAST(coalesce(m.n, 0) AS BIGINT) AS merged_rows,
       CAST(t.n - coalesce(m.n, 0) AS BIGINT) AS dropped_rows,
       round(CASE WHEN t.n > 0 THEN 100.0 * (t.n - coalesce(m.n, 0)) / t.n ELSE 0 END, 6) AS drop_rate_pct,
       CAST(coalesce(d.ids, 0) AS BIGINT) AS dropped_npis,
       CAST(coalesce(r.rows, 0) AS BIGINT) AS recoverable_rows,
       CAST(coalesce(r.ids, 0) AS BIGINT) AS recoverable_npis,
       round(CASE WHEN t.n - coalesce(m.n, 0) > 0
                  THEN 100.0 * coalesce(r.rows, 0) / (t.n - coalesce(m.n, 0)) ELSE 0 END, 6)
         AS recovery_rate_of_drops_pct,
       CAST(coalesce(d.rows, 0) AS BIGINT) AS anti_rows
FROM (SELECT year_month, count(*) n FROM v_dental GROUP BY 1) t
LEFT JOIN (SELECT year_month, count(*) n FROM v_merged GROUP BY 1) m USING (year_month)
LEFT JOIN (SELECT year_month, count(*) ids, sum(n_rows) rows FROM dr GROUP BY 1) d USING (year_month)
LEFT JOIN (SELECT year_month, count(*) ids, sum(n_rows) rows FROM rc GROUP BY 1) r USING (year_month)"""


def _coverage(spark, sf):
    return Q.coverage_report(_ids(spark, sf)[1], 1)


@register("coverage_report", with_views(_COV_SQL, ID_CTES))
def coverage_report(spark, sf):
    """Monthly coverage report with ±1 month recovery."""
    return _coverage(spark, sf)


@register("coverage_total", with_views("""
SELECT CAST(sum(hhs_dental_rows) AS BIGINT) AS hhs_dental_rows, CAST(sum(merged_rows) AS BIGINT) AS merged_rows,
       CAST(sum(dropped_rows) AS BIGINT) AS dropped_rows, CAST(sum(recoverable_rows) AS BIGINT) AS recoverable_rows,
       CAST(sum(dropped_rows) - sum(recoverable_rows) AS BIGINT) AS residual_rows,
       round(100.0 * sum(merged_rows) / sum(hhs_dental_rows), 6) AS merged_pct,
       round(100.0 * sum(dropped_rows) / sum(hhs_dental_rows), 6) AS dropped_pct,
       round(100.0 * sum(recoverable_rows) / sum(dropped_rows), 6) AS recoverable_pct_of_drops,
       round(100.0 * sum(recoverable_rows) / sum(hhs_dental_rows), 6) AS recoverable_pct_of_total,
       round(100.0 * (sum(dropped_rows) - sum(recoverable_rows)) / sum(hhs_dental_rows), 6) AS residual_pct_of_total
FROM cov""", {**ID_CTES, "cov": _COV_SQL}))
def coverage_total(spark, sf):
    """A10: overall coverage totals."""
    return Q.coverage_total(_coverage(spark, sf))


_BUCKET_SQL = """
SELECT bucket, CAST(count(*) AS BIGINT) AS n_id_months, CAST(sum(n_rows) AS BIGINT) AS n_rows,
       round(100.0 * sum(n_rows) / (SELECT sum(n_rows) FROM dr), 6) AS pct_of_dropped_rows
FROM (SELECT CASE WHEN distance IS NULL THEN 'never' WHEN distance <= 1 THEN '<=1' WHEN distance <= 3 THEN '<=3'
                  WHEN distance <= 6 THEN '<=6' WHEN distance <= 12 THEN '<=12' ELSE '>12' END AS bucket, n_rows
      FROM nm
      UNION ALL SELECT 'null_id', n_rows FROM dr WHERE servicing_id IS NULL)
GROUP BY bucket"""


def _buckets(spark, sf):
    return Q.distance_buckets(_ids(spark, sf)[2])


@register("drop_distance_buckets", with_views(_BUCKET_SQL, ID_CTES))
def drop_distance_buckets(spark, sf):
    """Dropped rows by distance to the nearest month with the id."""
    return _buckets(spark, sf)


@register("drop_verdict", with_views("""
SELECT round(never / greatest(total, 1), 6) AS never_share, round(near / greatest(total, 1), 6) AS near_share,
       CASE WHEN never / greatest(total, 1) > 0.8 THEN 'structural'
            WHEN near / greatest(total, 1) > 0.5 THEN 'comparison_bug' ELSE 'mixed' END AS verdict
FROM (SELECT CAST(sum(n_rows) AS DOUBLE) total,
             CAST(sum(n_rows) FILTER (WHERE bucket = 'never') AS DOUBLE) never,
             CAST(coalesce(sum(n_rows) FILTER (WHERE bucket = '<=1'), 0) AS DOUBLE) near FROM bk)""",
    {**ID_CTES, "bk": _BUCKET_SQL}))
def drop_verdict(spark, sf):
    """Verdict on why rows drop."""
    return Q.drop_verdict(_buckets(spark, sf))


@register("dropped_sample", with_views("""
SELECT servicing_id FROM (SELECT DISTINCT servicing_id FROM dr WHERE servicing_id IS NOT NULL)
ORDER BY md5(servicing_id || '42'), servicing_id LIMIT 5""", ID_CTES))
def dropped_sample(spark, sf):
    """Five dropped ids chosen by a seeded hash order."""
    dr = _ids(spark, sf)[2]
    ids = dr.filter(F.col("servicing_id").isNotNull()).select("servicing_id").distinct()
    return S.stable_sample(ids, "servicing_id", 5, "42")


_ID_SQL = """
SELECT bucket, CAST(count(DISTINCT servicing_id) AS BIGINT) AS unique_ids, CAST(sum(n_rows) AS BIGINT) AS row_count,
       CAST(sum(coalesce(claims, 0)) AS BIGINT) AS total_claims,
       CAST(sum(coalesce(paid, 0)) AS DECIMAL(38,2)) AS total_paid_usd,
       round(100.0 * sum(n_rows) / (SELECT sum(n_rows) FROM fb), 6) AS pct_of_rows,
       round(100.0 * sum(coalesce(claims, 0)) / (SELECT sum(claims) FROM fb), 6) AS pct_of_claims,
       round(100.0 * CAST(sum(coalesce(paid, 0)) AS DOUBLE) / CAST((SELECT sum(paid) FROM fb) AS DOUBLE), 6)
         AS pct_of_dollars
FROM (
  SELECT fb.*, CASE
    WHEN servicing_id IS NULL OR servicing_id IN ('', 'nan', '<NA>') THEN 'NULL'
    WHEN t = '0000000000' THEN 'sentinel: all zeros'
    WHEN regexp_full_match(t, '[19]+') AND contains(t, '9') THEN 'sentinel: nines pattern'
    WHEN regexp_full_match(t, '[A-Z][A-Z0-9]{9}') THEN
      CASE left(t, 1) WHEN 'A' THEN 'state-assigned: A-prefix (Atypical)'
                      WHEN 'M' THEN 'state-assigned: M-prefix (Medicaid)'
                      ELSE 'state-assigned: ' || left(t, 1) || '-prefix' END
    WHEN regexp_full_match(t, '[0-9]{10}') THEN
      CASE WHEN EXISTS (SELECT 1 FROM v_snapshots s WHERE s.npi = fb.servicing_id AND s.ym = fb.year_month)
             THEN 'NPI-format: matched same-month'
           WHEN EXISTS (SELECT 1 FROM v_snapshots s WHERE s.npi = fb.servicing_id)
             THEN 'NPI-format: matched other-month'
           ELSE 'NPI-format: unmatched any-month' END
    ELSE 'other malformed' END AS bucket
  FROM (SELECT *, upper(trim(servicing_id)) AS t FROM fb) fb)
GROUP BY bucket"""


@register("id_buckets", with_views(_ID_SQL, ID_CTES))
def id_buckets(spark, sf):
    """Q5: servicing-id buckets with ids, rows, claims, dollars and shares."""
    return Q.id_bucket_report(_ids(spark, sf)[1])


# ---- colour scale -------------------------------------------------------------

def _level_values(spark, sf, metric: str):
    """Values of every (level, region, year, layer): one aggregate over the
    claim rows exploded to (level, layer) keys and, for rates, one join to
    the union of the three levels' denominators."""
    b = bind(spark, sf)
    lv = R.level_layer_values(base(spark, sf), A.LEVEL_KEYS, "year")
    denom = None
    if metric == "enrollees":
        parts = {"state": D.enrollment_by(b.enroll_county, "state", A.fips_dimension(spark), strict=False),
                 "county": b.enroll_county, "zip3": D.enrollment_by(b.enroll_zcta, "zip3")}
        denom = None
        for level, d in parts.items():
            d = d.select(F.lit(level).alias("level"), "region_id", "year", "medicaid_enrollees")
            denom = d if denom is None else denom.unionByName(d)
    v = R.values_of(lv, metric=metric, denom=denom, extra=["level"])
    return v.select("level", "key", "period", "layer", "value")


def _stops_sql(scope: str, top: float, gap: float, values_sql: str) -> dict[str, str]:
    qs = list(K.QUANTILES_BASE) + [top]
    picks = ", ".join(
        f"arr[CAST(least(n - 1, floor(CAST({q} AS DOUBLE) * n)) AS BIGINT) + 1] AS r{i}" for i, q in enumerate(qs))
    ctes = {
        "vals": values_sql,
        "srt": f"SELECT {scope}, list_sort(list(value)) AS arr, count(*) AS n FROM vals "
               f"WHERE value IS NOT NULL AND value > 0 GROUP BY ALL",
        "raw": f"SELECT {scope}, {picks} FROM srt",
        "f0": f"SELECT {scope}, r0 AS s0, r1, r2, r3, r4, r5, r6 FROM raw",
    }
    for i in range(1, K.N_STOPS):
        prev = f"f{i - 1}"
        keep = ", ".join(f"r{j}" for j in range(i + 1, K.N_STOPS))
        keep = (", " + keep) if keep else ""
        ss = ", ".join(f"s{j}" for j in range(i))
        ctes[f"f{i}"] = (f"SELECT {scope}, {ss}, CASE WHEN r{i} > s{i - 1} THEN r{i} ELSE s{i - 1} + {gap} END "
                         f"AS s{i}{keep} FROM {prev}")
    ctes["stops"] = (f"SELECT u.{scope.replace(', ', ', u.')}, "
                     + ", ".join(f"coalesce(f.s{i}, {float(i)}) AS s{i}" for i in range(K.N_STOPS))
                     + f" FROM (SELECT DISTINCT {scope} FROM vals) u LEFT JOIN f6 f USING ({scope})")
    return ctes


_VOL_VALUES = """
SELECT 'state' AS level, state AS key, year AS period, layer, CAST(sum(claims) AS DOUBLE) AS value
  FROM v_base JOIN layer_map USING (category) WHERE state IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'state', state, year, 'all', CAST(sum(claims) AS DOUBLE) FROM v_base WHERE state IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'county', county_fips, year, layer, CAST(sum(claims) AS DOUBLE)
  FROM v_base JOIN layer_map USING (category) WHERE county_fips IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'county', county_fips, year, 'all', CAST(sum(claims) AS DOUBLE) FROM v_base
  WHERE county_fips IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'zip3', zip3, year, layer, CAST(sum(claims) AS DOUBLE)
  FROM v_base JOIN layer_map USING (category) WHERE zip3 IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'zip3', zip3, year, 'all', CAST(sum(claims) AS DOUBLE) FROM v_base WHERE zip3 IS NOT NULL GROUP BY ALL"""

_RATE_VALUES = """
SELECT v.level, v.key, v.period, v.layer,
       CASE WHEN e.medicaid_enrollees > 0 THEN v.value / e.medicaid_enrollees END AS value
FROM vol v LEFT JOIN (
  SELECT 'county' AS level, region_id, year, medicaid_enrollees FROM v_enroll_county
  UNION ALL SELECT 'state', m.postal, e.year, CAST(sum(e.medicaid_enrollees) AS BIGINT)
    FROM v_enroll_county e JOIN fips_map m ON m.state_fips = left(e.region_id, 2) GROUP BY ALL
  UNION ALL SELECT 'zip3', left(region_id, 3), year, CAST(sum(medicaid_enrollees) AS BIGINT)
    FROM v_enroll_zcta GROUP BY ALL) e
ON e.level = v.level AND e.region_id = v.key AND e.year = v.period"""


@register("quantile_stops_claims", with_views(
    "SELECT level, period, layer, s0, s1, s2, s3, s4, s5, s6 FROM stops",
    _stops_sql("level, period, layer", K.TOP_CLIP["claims"], K.MIN_GAP["claims"], _VOL_VALUES)))
def quantile_stops_claims(spark, sf):
    """Volume stops per (level, year, layer)."""
    return C.quantile_stops(_level_values(spark, sf, "claims"), ["level", "period", "layer"], metric="claims")


@register("quantile_stops_rate", with_views(
    "SELECT period, layer, s0, s1, s2, s3, s4, s5, s6 FROM stops",
    {"vol": _VOL_VALUES, **_stops_sql("period, layer", K.TOP_CLIP["enrollees"], K.MIN_GAP["enrollees"],
                                      _RATE_VALUES)}))
def quantile_stops_rate(spark, sf):
    """W2 + U4: one rate scale per (year, layer) shared by all three levels."""
    return C.quantile_stops(_level_values(spark, sf, "enrollees"), ["period", "layer"], metric="enrollees")


_band = "CASE WHEN v.value IS NULL THEN NULL WHEN v.value <= s0 THEN 0 WHEN v.value >= s6 THEN 6 " + " ".join(
    f"WHEN v.value BETWEEN s{i} AND s{i + 1} THEN {i}" for i in range(6)) + " ELSE 6 END"
_t = "CASE WHEN v.value IS NULL OR v.value <= s0 OR v.value >= s6 THEN 0.0 " + " ".join(
    f"WHEN v.value BETWEEN s{i} AND s{i + 1} THEN (CASE WHEN s{i + 1} > s{i} THEN (v.value - s{i}) / (s{i + 1} - s{i})"
    f" ELSE 0.0 END)" for i in range(6)) + " ELSE 0.0 END"


@register("color_class", with_views(
    f"""SELECT v.level, v.key, v.period, v.layer, v.value, CAST({_band} AS INTEGER) AS band, round({_t}, 6) AS t,
       v.value IS NULL AS no_data
FROM vals v JOIN stops USING (level, period, layer)""",
    _stops_sql("level, period, layer", K.TOP_CLIP["claims"], K.MIN_GAP["claims"], _VOL_VALUES)))
def color_class(spark, sf):
    """Palette band and fraction for every region value."""
    vals = _level_values(spark, sf, "claims")
    scope = ["level", "period", "layer"]
    return C.color_class(vals, C.quantile_stops(vals, scope, metric="claims"), scope)


@register("color_class_rate", with_views(
    f"""SELECT v.level, v.key, v.period, v.layer, v.value, CAST({_band} AS INTEGER) AS band, round({_t}, 6) AS t,
       v.value IS NULL AS no_data
FROM vals v JOIN stops USING (period, layer)""",
    {"vol": _VOL_VALUES, **_stops_sql("period, layer", K.TOP_CLIP["enrollees"], K.MIN_GAP["enrollees"], _RATE_VALUES)}))
def color_class_rate(spark, sf):
    """Bands of rates; regions without a denominator are ``no_data``."""
    vals = _level_values(spark, sf, "enrollees")
    return C.color_class(vals, C.quantile_stops(vals, ["period", "layer"], metric="enrollees"), ["period", "layer"])


# ---- optional documented rules ---------------------------------------------------

@register("suppress_small_cells", with_views("""
SELECT key, period, category,
       CASE WHEN c < 12 OR b < 12 THEN NULL ELSE CAST(b AS BIGINT) END AS total_beneficiaries_served,
       CASE WHEN c < 12 OR b < 12 THEN NULL ELSE CAST(c AS BIGINT) END AS total_claims,
       CASE WHEN c < 12 OR b < 12 THEN NULL ELSE CAST(p AS DECIMAL(38,2)) END AS total_amount_paid,
       c < 12 OR b < 12 AS suppressed
FROM (SELECT county_fips AS key, year_month AS period, category, sum(benef) b, sum(claims) c, sum(paid) p
      FROM v_base WHERE county_fips IS NOT NULL GROUP BY ALL)"""))
def suppress_small_cells(spark, sf):
    """Q7: small-cell suppression (fewer than 12 claims or beneficiaries)."""
    return Q.suppress_small_cells(A.category_aggregate(base(spark, sf), "county_fips", "year_month"))


_CLEAN = "(CASE WHEN TRY_CAST({x} AS DOUBLE) IN (" + ", ".join(str(s) for s in K.SURVEY_SENTINELS) + \
         ") THEN NULL ELSE TRY_CAST({x} AS DOUBLE) END)"


@register("reliability_flags", with_views(f"""
SELECT year, geoid, k, v AS medicaid_enrollees, round(m, 6) AS medicaid_enrollees_moe,
       (v IS NULL OR m IS NULL OR m > 0.5 * v) AS unreliable
FROM (SELECT year, geoid, k, {' + '.join(_CLEAN.format(x=c) for c in CELLS)} AS v,
             sqrt({' + '.join('pow(' + _CLEAN.format(x=c) + ', 2)' for c in MARGINS)}) AS m FROM v_survey)"""))
def reliability_flags(spark, sf):
    """Q8: survey estimates whose margin exceeds half the estimate."""
    p = survey(spark, sf).select("year", "geoid", "k", "medicaid_enrollees", "medicaid_enrollees_moe")
    out = Q.reliability_flags(p, "medicaid_enrollees", "medicaid_enrollees_moe")
    return out.withColumn("medicaid_enrollees_moe", F.round("medicaid_enrollees_moe", 6))
