"""Queries over denominators, rates and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import aggregate as A
from ..operators import denominators as D
from ..operators import export as E
from ..operators import rates as R
from .catalog import bind, register
from .oracle_views import with_views
from .q_aggregate import base

CELLS = [f"e{i}" for i in range(1, 7)]
MARGINS = [f"m{i}" for i in range(1, 7)]
_SENT = ", ".join(str(x) for x in K.SURVEY_SENTINELS)


def _clean(x: str) -> str:
    return f"(CASE WHEN TRY_CAST({x} AS DOUBLE) IN ({_SENT}) THEN NULL ELSE TRY_CAST({x} AS DOUBLE) END)"


def _agg_cte(key: str, period: str) -> str:
    return (f"SELECT {key} AS key, {period} AS period, category, sum(benef) b, sum(claims) c, sum(paid) p "
            f"FROM v_base WHERE {key} IS NOT NULL GROUP BY ALL")


_LAYERED = """
  SELECT key, period, l.layer, CAST(sum(b) AS BIGINT) AS total_beneficiaries_served,
         CAST(sum(c) AS BIGINT) AS total_claims, CAST(sum(p) AS DECIMAL(38,2)) AS total_amount_paid
  FROM agg JOIN layer_map l USING (category) GROUP BY ALL
  UNION ALL
  SELECT key, period, 'all', CAST(sum(b) AS BIGINT), CAST(sum(c) AS BIGINT), CAST(sum(p) AS DECIMAL(38,2))
  FROM agg GROUP BY ALL"""


def _rate(num: str, den: str) -> str:
    return (f"(CASE WHEN {den} > 0 THEN CAST((2 * {num} * 1000000 + {den}) // (2 * {den}) AS DOUBLE) "
            f"/ 1000000.0 END)")


def survey(spark, sf):
    return D.survey_panel(bind(spark, sf).survey, CELLS, MARGINS, keys=["year", "geoid", "k"])


@register("strict_row_sum", with_views(f"""
SELECT year, geoid, k, {' + '.join(_clean(c) for c in CELLS)} AS medicaid_enrollees
FROM v_survey"""))
def strict_row_sum(spark, sf):
    """X15 + A16: cleaned survey cells summed, NULL if any cell is missing."""
    return survey(spark, sf).select("year", "geoid", "k", "medicaid_enrollees")


@register("margin_of_sum", with_views(f"""
SELECT year, geoid, k, round(sqrt({' + '.join(f'pow({_clean(c)}, 2)' for c in MARGINS)}), 6)
       AS medicaid_enrollees_moe
FROM v_survey"""))
def margin_of_sum(spark, sf):
    """Margin of the summed estimate."""
    return survey(spark, sf).select("year", "geoid", "k",
                                    F.round("medicaid_enrollees_moe", 6).alias("medicaid_enrollees_moe"))


@register("panel_validation", with_views(f"""
SELECT year, CAST(count(*) AS BIGINT) AS n_rows,
       CAST(count(*) FILTER (WHERE v IS NULL) AS BIGINT) AS n_missing, sum(v) AS total
FROM (SELECT year, {' + '.join(_clean(c) for c in CELLS)} AS v FROM v_survey)
GROUP BY year"""))
def panel_validation(spark, sf):
    """Rows, missing values and total per year."""
    return D.panel_validation(survey(spark, sf))


@register("enrollment_state", with_views("""
SELECT coalesce(m.postal, left(e.region_id, 2)) AS region_id, e.year,
       CAST(sum(e.medicaid_enrollees) AS BIGINT) AS medicaid_enrollees
FROM v_enroll_county e LEFT JOIN fips_map m ON m.state_fips = left(e.region_id, 2)
GROUP BY ALL"""))
def enrollment_state(spark, sf):
    """County denominators rolled up to states; the fixture's unmapped
    prefix, on which the strict default raises, is a region of its own."""
    return D.enrollment_by(bind(spark, sf).enroll_county, "state", A.fips_dimension(spark), strict=False)


@register("enrollment_zip3", with_views("""
SELECT left(region_id, 3) AS region_id, year, CAST(sum(medicaid_enrollees) AS BIGINT) AS medicaid_enrollees
FROM v_enroll_zcta GROUP BY ALL"""))
def enrollment_zip3(spark, sf):
    """ZCTA denominators rolled up to 3-digit prefixes."""
    return D.enrollment_by(bind(spark, sf).enroll_zcta, "zip3")


@register("region_value_claims", with_views(
    f"""SELECT key, period, layer, total_claims, CAST(total_claims AS DOUBLE) AS value FROM layered""",
    {"agg": _agg_cte("state", "year"), "layered": _LAYERED}))
def region_value_claims(spark, sf):
    """A20 + F3: claims per state for every (year, layer) slice."""
    return R.region_value(A.category_aggregate(base(spark, sf), "state", "year"))


def _rate_sql(period: str) -> str:
    return with_views(
        f"""SELECT l.key, l.period, l.layer, l.total_claims, e.medicaid_enrollees,
       CASE WHEN e.medicaid_enrollees > 0 THEN CAST(l.total_claims AS DOUBLE) / e.medicaid_enrollees END AS value
FROM layered l LEFT JOIN v_enroll_county e ON e.region_id = l.key AND e.year = left(l.period, 4)""",
        {"agg": _agg_cte("county_fips", period), "layered": _LAYERED})


@register("claims_per_enrollee_annual", _rate_sql("year"))
def claims_per_enrollee_annual(spark, sf):
    """A20 + J8 + X16: claims per enrollee per county, year and layer."""
    b = bind(spark, sf)
    agg = A.category_aggregate(base(spark, sf), "county_fips", "year")
    return R.region_value(agg, metric="enrollees", denom=b.enroll_county)


@register("claims_per_enrollee_monthly", _rate_sql("year_month"))
def claims_per_enrollee_monthly(spark, sf):
    """As above per month, with the year's denominator."""
    b = bind(spark, sf)
    agg = A.category_aggregate(base(spark, sf), "county_fips", "year_month")
    return R.region_value(agg, metric="enrollees", denom=b.enroll_county)


@register("region_detail", with_views(f"""
SELECT t.key, t.period, t.total_claims, t.total_amount_paid, e.medicaid_enrollees,
       round(CASE WHEN t.total_claims > 0 THEN CAST(t.total_amount_paid AS DOUBLE) / t.total_claims END, 6)
         AS paid_per_claim,
       {_rate('t.total_claims', 'e.medicaid_enrollees')} AS claims_per_enrollee
FROM (SELECT county_fips AS key, year AS period, CAST(sum(claims) AS BIGINT) AS total_claims,
             CAST(sum(paid) AS DECIMAL(38,2)) AS total_amount_paid
      FROM v_base WHERE county_fips IS NOT NULL GROUP BY ALL) t
LEFT JOIN v_enroll_county e ON e.region_id = t.key AND e.year = t.period"""))
def region_detail(spark, sf):
    """A26 + X17: per county and year, totals and guarded ratios."""
    b = bind(spark, sf)
    return R.region_detail(A.category_aggregate(base(spark, sf), "county_fips", "year"), b.enroll_county)


@register("category_ranking", with_views("""
SELECT key, period, category, total_claims,
       (SELECT CAST(count(*) AS INTEGER) + 1 FROM a a2 WHERE a2.key = a.key AND a2.period = a.period
          AND (a2.total_claims > a.total_claims OR (a2.total_claims = a.total_claims AND a2.category < a.category)))
         AS rank,
       round(100.0 * total_claims / greatest((SELECT max(total_claims) FROM a a3
                                               WHERE a3.key = a.key AND a3.period = a.period), 1), 6) AS bar_pct
FROM a""", {"a": "SELECT state AS key, year AS period, category, CAST(sum(claims) AS BIGINT) AS total_claims "
                 "FROM v_base WHERE state IS NOT NULL GROUP BY ALL"}))
def category_ranking(spark, sf):
    """Categories ranked within each state and year."""
    return R.category_ranking(A.category_aggregate(base(spark, sf), "state", "year"))


@register("view_export_all", with_views("""
SELECT l.key AS region_id, coalesce(n.state_name, l.key) AS region_name, 'state' AS level, l.period AS year,
       'All Categories' AS category, total_claims, total_beneficiaries_served, total_amount_paid
FROM layered l LEFT JOIN state_names n ON n.postal = l.key
WHERE layer = 'all' AND NOT (total_claims = 0 AND total_beneficiaries_served = 0 AND total_amount_paid = 0)""",
    {"agg": _agg_cte("state", "year"), "layered": _LAYERED}))
def view_export_all(spark, sf):
    """A22 + F6 + K5: current-view rows for every year, all categories, states."""
    return E.view_export(A.category_aggregate(base(spark, sf), "state", "year"), "state")


@register("view_export_category", with_views("""
SELECT l.key AS region_id, l.key AS region_name, 'county' AS level, l.period AS year,
       'Preventive' AS category, total_claims, total_beneficiaries_served, total_amount_paid
FROM layered l
WHERE layer = 'preventive' AND NOT (total_claims = 0 AND total_beneficiaries_served = 0 AND total_amount_paid = 0)""",
    {"agg": _agg_cte("county_fips", "year_month"), "layered": _LAYERED}))
def view_export_category(spark, sf):
    """Current-view rows for one layer, every month, counties."""
    return E.view_export(A.category_aggregate(base(spark, sf), "county_fips", "year_month"), "county",
                         layer="preventive")


_SUBSET_SQL = """
SELECT l.key AS region_id, {name} AS region_name, '{level}' AS level, l.period,
       coalesce(lm.label, 'All Categories') AS category,
       total_claims, total_beneficiaries_served, total_amount_paid, e.medicaid_enrollees,
       {rate} AS claims_per_enrollee
FROM layered l
LEFT JOIN (SELECT DISTINCT layer, label FROM layer_map) lm ON lm.layer = l.layer
LEFT JOIN {denom} e ON e.region_id = l.key AND e.year = left(l.period, 4)
WHERE (l.layer IN ({cats}) {all_clause})
  AND NOT (total_claims = 0 AND total_beneficiaries_served = 0 AND total_amount_paid = 0)"""


@register("subset_export", with_views(
    _SUBSET_SQL.format(name="l.key", level="county", rate=_rate("total_claims", "e.medicaid_enrollees"),
                       denom="v_enroll_county", cats="'preventive', 'restorative'", all_clause=""),
    {"agg": _agg_cte("county_fips", "year"), "layered": _LAYERED}))
def subset_export(spark, sf):
    """A23 + K6: counties x years x {preventive, restorative} with denominators."""
    b = bind(spark, sf)
    agg = A.category_aggregate(base(spark, sf), "county_fips", "year")
    return E.subset_export(agg, "county", denom=b.enroll_county, categories=["preventive", "restorative"])


@register("subset_export_all", with_views(
    _SUBSET_SQL.format(name="'ZIP3 ' || l.key", level="zip3", rate=_rate("total_claims", "e.medicaid_enrollees"),
                       denom="ez", cats="'diagnostic'", all_clause="OR l.layer = 'all'"),
    {"agg": _agg_cte("zip3", "year_month"), "layered": _LAYERED,
     "ez": "SELECT left(region_id, 3) AS region_id, year, CAST(sum(medicaid_enrollees) AS BIGINT) "
           "AS medicaid_enrollees FROM v_enroll_zcta GROUP BY ALL"}))
def subset_export_all(spark, sf):
    """ZIP3 x months x {diagnostic} plus the All Categories row."""
    b = bind(spark, sf)
    agg = A.category_aggregate(base(spark, sf), "zip3", "year_month")
    denom = D.enrollment_by(b.enroll_zcta, "zip3")
    return E.subset_export(agg, "zip3", denom=denom, categories=["diagnostic"], include_all=True)


@register("available_periods", with_views("""
SELECT DISTINCT year_month AS period FROM v_base WHERE state IS NOT NULL"""))
def available_periods(spark, sf):
    """Distinct months of the monthly state output."""
    return E.available_periods(A.category_aggregate(base(spark, sf), "state", "year_month"))


@register("subset_estimate", with_views("""
SELECT CAST(n_r * n_p * 3 AS BIGINT) AS estimated_rows, n_r * n_p * 3 > 250000 AS over_cap
FROM (SELECT count(DISTINCT county_fips) n_r, count(DISTINCT year) n_p FROM v_base WHERE county_fips IS NOT NULL)"""))
def subset_estimate(spark, sf):
    """Estimated export rows for all counties x all years x 2 layers + all."""
    agg = A.category_aggregate(base(spark, sf), "county_fips", "year")
    return E.estimate_rows(agg.select("key"), agg.select("period"), 2, include_all=True)


@register("region_search", with_views("""
WITH d AS (SELECT DISTINCT b.state AS region_id, coalesce(n.state_name, b.state) AS region_name
           FROM v_base b LEFT JOIN state_names n ON n.postal = b.state WHERE b.state IS NOT NULL),
     m AS (SELECT * FROM d WHERE contains(lower(region_id), 'in') OR contains(lower(region_name), 'in'))
SELECT region_id, region_name, (SELECT CAST(count(*) AS BIGINT) FROM m) AS n_matches
FROM m ORDER BY region_id LIMIT 250"""))
def region_search(spark, sf):
    """F8 + O4: states whose id or name contains 'in' (first 250 + count)."""
    agg = A.category_aggregate(base(spark, sf), "state", "year")
    return E.search_regions(E.region_dimension(spark, agg, "state"), "  IN ")
