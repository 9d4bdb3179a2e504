"""Queries of the scan / filter / join / aggregate core."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregate as A
from ..operators import snapshot as S
from .catalog import bind, register
from .oracle_views import with_views

SUMS_SQL = """CAST(sum(benef) AS BIGINT) AS total_beneficiaries_served,
       CAST(sum(claims) AS BIGINT) AS total_claims,
       CAST(sum(paid) AS DECIMAL(38,2)) AS total_amount_paid"""


def base(spark, sf):
    b = bind(spark, sf)
    return A.categorised_base(b.merged, A.fips_dimension(spark))


@register("code_prefix_filter", with_views("""
SELECT servicing_id, code, year_month, benef, claims, paid
FROM v_claims WHERE code LIKE 'D%'"""))
def code_prefix_filter(spark, sf):
    """keep codes starting with 'D' (NULL codes drop)."""
    return bind(spark, sf).dental


@register("snapshot_join", with_views("""
SELECT c.servicing_id, c.year_month, c.code, c.claims, s.zip5, s.county_fips
FROM v_claims c, v_snapshots s
WHERE c.code LIKE 'D%' AND s.npi = c.servicing_id AND s.ym = c.year_month"""))
def snapshot_join(spark, sf):
    """Same-month inner equi join of claims to the registry snapshots."""
    b = bind(spark, sf)
    s = b.snapshots.select("npi", "ym", "zip5", "county_fips")
    return S.snapshot_join(b.dental, s).select("servicing_id", "year_month", "code", "claims", "zip5", "county_fips")


def _agg_sql(key: str, period: str) -> str:
    return with_views(f"""
SELECT {key} AS key, {period} AS period, category,
       {SUMS_SQL}
FROM v_base WHERE {key} IS NOT NULL
GROUP BY ALL""")


for _grain, (_pcol, _) in A.GRAIN_PERIODS.items():
    for _level, _kcol in A.LEVEL_KEYS.items():
        def _mk(kcol=_kcol, pcol=_pcol):
            def q(spark, sf):
                return A.category_aggregate(base(spark, sf), kcol, pcol)
            q.__doc__ = f"A1: category aggregate by ({kcol}, {pcol})."
            return q
        register(f"agg_{_grain}_{_level}", _agg_sql(_kcol, _pcol))(_mk())


@register("state_rollup", with_views("""
SELECT m.postal AS key, c.period, c.category,
       CAST(sum(c.b) AS BIGINT) AS total_beneficiaries_served,
       CAST(sum(c.c) AS BIGINT) AS total_claims,
       CAST(sum(c.p) AS DECIMAL(38,2)) AS total_amount_paid
FROM (SELECT county_fips, year AS period, category, sum(benef) b, sum(claims) c, sum(paid) p
      FROM v_base WHERE county_fips IS NOT NULL GROUP BY ALL) c
JOIN fips_map m ON m.state_fips = left(c.county_fips, 2)
GROUP BY ALL"""))
def state_rollup(spark, sf):
    """A2 + J3: state totals rolled up from county totals."""
    county = A.category_aggregate(base(spark, sf), "county_fips", "year")
    return A.roll_up(county, A.fips_dimension(spark))


def _invariant(spark, sf, fine_grain: str, coarse_grain: str, same_level: bool):
    bs = base(spark, sf)
    if same_level:   # annual vs monthly at county level
        monthly = A.category_aggregate(bs, "county_fips", "year_month").withColumn(
            "period", F.substring("period", 1, 4))
        coarse = A.category_aggregate(bs, "county_fips", "year")
        keys = ["key", "period", "category"]
        fine = monthly
    else:            # state vs counties, annual
        county = A.category_aggregate(bs, "county_fips", "year")
        fine = A.attach_parent(county, "key", A.fips_dimension(spark), alias="parent") \
            .filter(F.col("parent").isNotNull()).drop("key").withColumnRenamed("parent", "key")
        coarse = A.category_aggregate(bs, "state", "year")
        keys = ["key", "period", "category"]
    bad = A.check_additive(fine, coarse, keys)
    return bad.agg(F.count(F.lit(1)).alias("n_mismatch")).select(
        F.lit(f"{fine_grain}_vs_{coarse_grain}").alias("check"), "n_mismatch",
        (F.col("n_mismatch") == 0).alias("ok"))


@register("invariant_state_county", with_views("""
WITH s AS (SELECT state AS key, year AS period, category, sum(claims) c, sum(benef) b, sum(paid) p
           FROM v_base WHERE state IS NOT NULL GROUP BY ALL),
     k AS (SELECT m.postal AS key, year AS period, category, sum(claims) c, sum(benef) b, sum(paid) p
           FROM v_base v JOIN fips_map m ON m.state_fips = left(v.county_fips, 2) GROUP BY ALL)
SELECT 'county_vs_state' AS "check", CAST(count(*) AS BIGINT) AS n_mismatch, count(*) = 0 AS ok
FROM s FULL JOIN k USING (key, period, category)
WHERE coalesce(s.c, 0) <> coalesce(k.c, 0) OR coalesce(s.b, 0) <> coalesce(k.b, 0)
   OR coalesce(s.p, 0) <> coalesce(k.p, 0)"""))
def invariant_state_county(spark, sf):
    """A3: state = sum of its counties (empty mismatch set)."""
    return _invariant(spark, sf, "county", "state", same_level=False)


@register("invariant_annual_monthly", with_views("""
WITH y AS (SELECT county_fips AS key, year AS period, category, sum(claims) c, sum(benef) b, sum(paid) p
           FROM v_base WHERE county_fips IS NOT NULL GROUP BY ALL),
     mo AS (SELECT key, left(period, 4) AS period, category, sum(c) c, sum(b) b, sum(p) p
            FROM (SELECT county_fips AS key, year_month AS period, category,
                         sum(claims) c, sum(benef) b, sum(paid) p
                  FROM v_base WHERE county_fips IS NOT NULL GROUP BY ALL) GROUP BY ALL)
SELECT 'monthly_vs_annual' AS "check", CAST(count(*) AS BIGINT) AS n_mismatch, count(*) = 0 AS ok
FROM y FULL JOIN mo USING (key, period, category)
WHERE coalesce(y.c, 0) <> coalesce(mo.c, 0) OR coalesce(y.b, 0) <> coalesce(mo.b, 0)
   OR coalesce(y.p, 0) <> coalesce(mo.p, 0)"""))
def invariant_annual_monthly(spark, sf):
    """A3: annual = sum of months (empty mismatch set)."""
    return _invariant(spark, sf, "monthly", "annual", same_level=True)


_GRAINS = " UNION ALL ".join(
    f"SELECT '{p}' AS grain, '{level}' AS level, {k} AS key, {p} AS period, category, sum(claims) c, sum(benef) b, sum(paid) p "
    f"FROM v_base WHERE {k} IS NOT NULL GROUP BY {k}, {p}, category"
    for p in ("year", "year_month") for level, k in A.LEVEL_KEYS.items())


@register("output_invariants", with_views("""
SELECT level, "check", CAST(n_bad AS BIGINT) AS n_bad, n_bad = 0 AS ok FROM (
  SELECT level, 'grain_unique' AS "check", sum(n - 1) AS n_bad
  FROM (SELECT grain, level, count(*) AS n FROM grains GROUP BY grain, level, key, period, category) GROUP BY level
  UNION ALL
  SELECT level, 'annual_is_months', count(*) FILTER (y.c IS DISTINCT FROM m.c OR y.b IS DISTINCT FROM m.b OR y.p IS DISTINCT FROM m.p)
  FROM (SELECT * FROM grains WHERE grain = 'year') y
  FULL JOIN (SELECT level, key, left(period, 4) AS period, category, sum(c) c, sum(b) b, sum(p) p
             FROM grains WHERE grain = 'year_month' GROUP BY 1, 2, 3, 4) m USING (level, key, period, category)
  GROUP BY level)""", {"grains": _GRAINS}))
def output_invariants(spark, sf):
    """A3: unique grain and annual = sum of months, for all three levels."""
    return A.output_invariants(A.multi_level_aggregate(base(spark, sf), A.LEVEL_KEYS, ("year", "year_month")))


@register("unmapped_prefix", with_views("""
SELECT CAST(count(*) AS BIGINT) AS n_rows,
       coalesce((SELECT string_agg(p, ',' ORDER BY p) FROM
                  (SELECT DISTINCT left(county_fips, 2) p FROM v_base
                   WHERE county_fips IS NOT NULL AND state IS NULL ORDER BY p LIMIT 10)), '') AS prefixes
FROM v_base WHERE county_fips IS NOT NULL AND state IS NULL"""))
def unmapped_prefix(spark, sf):
    """A4: rows whose county prefix maps to no state, and those prefixes."""
    return A.unmapped_prefixes(base(spark, sf))


_NDJSON_SQL = """
SELECT key, '{' || to_json(key) || ':' || to_json(list({year: period, category: category,
       total_beneficiaries_served: total_beneficiaries_served, total_claims: total_claims,
       total_amount_paid: total_amount_paid} ORDER BY period, category)) || '}' AS line,
       CAST(count(*) AS BIGINT) AS n_records
FROM (SELECT state AS key, year AS period, category, {sums}
      FROM v_base WHERE state IS NOT NULL GROUP BY ALL)
GROUP BY key""".replace("{sums}", SUMS_SQL)


@register("ndjson_lines", with_views(_NDJSON_SQL))
def ndjson_lines(spark, sf):
    """K3: keyed NDJSON lines of the annual state output."""
    return A.ndjson_lines(A.category_aggregate(base(spark, sf), "state", "year"))


@register("ndjson_roundtrip", _agg_sql("state", "year"))
def ndjson_roundtrip(spark, sf):
    """K3 -> S11: lines parsed back into rows equal the aggregate."""
    lines = A.ndjson_lines(A.category_aggregate(base(spark, sf), "state", "year"))
    return A.parse_ndjson_lines(lines.select(F.col("line").alias("value")))


@register("output_counts", with_views("""
SELECT output, CAST(count(DISTINCT key) AS BIGINT) AS n_keys, CAST(count(*) AS BIGINT) AS n_records FROM (
  SELECT 'annual_state' AS output, state AS key, year AS p, category FROM v_base WHERE state IS NOT NULL GROUP BY ALL
  UNION ALL SELECT 'annual_county', county_fips, year, category FROM v_base WHERE county_fips IS NOT NULL GROUP BY ALL
  UNION ALL SELECT 'annual_zip3', zip3, year, category FROM v_base WHERE zip3 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT 'monthly_state', state, year_month, category FROM v_base WHERE state IS NOT NULL GROUP BY ALL
  UNION ALL SELECT 'monthly_county', county_fips, year_month, category FROM v_base WHERE county_fips IS NOT NULL GROUP BY ALL
  UNION ALL SELECT 'monthly_zip3', zip3, year_month, category FROM v_base WHERE zip3 IS NOT NULL GROUP BY ALL)
GROUP BY output"""))
def output_counts(spark, sf):
    """A27 over K4: keys and records of all six outputs from one fine aggregate."""
    return A.output_counts(A.multi_level_aggregate(base(spark, sf), periods=("year", "year_month")))
