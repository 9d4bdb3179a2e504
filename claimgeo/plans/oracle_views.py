"""The role bindings of :mod:`claimgeo.plans.bindings` written as DuckDB SQL.

The oracle queries are independent SQL over the raw tables; they share only
these view definitions, which restate FIXTURES §3 in SQL. ``with_views``
prefixes a query with the views it needs (DuckDB ignores unused CTEs, but
trimming keeps the text readable).
"""

from __future__ import annotations

from .bindings import FIXTURE_NATION_STATE, UNMAPPED_STATE

_STATES = ", ".join(f"'{s}'" for s in FIXTURE_NATION_STATE)

VIEWS: dict[str, str] = {}

VIEWS["v_provider"] = f"""
  SELECT s_suppkey AS k, s_nationkey AS n, s_suppkey - s_suppkey % 2 AS a,
         '1' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS npi,
         lpad(CAST(((s_suppkey - s_suppkey % 2) * 613) % 100000 AS VARCHAR), 5, '0') AS zip5,
         CASE WHEN s_suppkey % 29 = 0 THEN NULL
              ELSE (CASE WHEN s_nationkey BETWEEN 0 AND {len(FIXTURE_NATION_STATE) - 1}
                         THEN ([{_STATES}])[s_nationkey + 1] ELSE '{UNMAPPED_STATE}' END)
                   || lpad(CAST((2 * s_suppkey + 1) % 1000 AS VARCHAR), 3, '0') END AS county_fips
  FROM supplier"""

VIEWS["v_claims"] = """
  SELECT CASE l_orderkey % 97
           WHEN 0 THEN NULL
           WHEN 1 THEN '0000000000'
           WHEN 2 THEN '9999999999'
           WHEN 3 THEN 'A' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0')
           WHEN 4 THEN 'M' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0')
           WHEN 5 THEN 'K' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0')
           WHEN 6 THEN '11014' || CAST(l_suppkey AS VARCHAR) || 'A'
           ELSE '1' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0') END AS servicing_id,
         CASE WHEN l_partkey % 50 = 0 THEN '99213'
              WHEN l_partkey % 50 = 1 THEN 'D12A4'
              ELSE 'D' || lpad(CAST((37 * l_partkey) % 10000 AS VARCHAR), 4, '0') END AS code,
         strftime(l_shipdate, '%Y-%m') AS year_month,
         CAST(l_linenumber AS BIGINT) AS benef,
         CAST(l_quantity AS BIGINT) AS claims,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS paid
  FROM lineitem"""

VIEWS["v_months"] = """
  SELECT DISTINCT year_month AS ym,
         CAST(substr(year_month, 1, 4) AS INTEGER) * 12 + CAST(substr(year_month, 6, 2) AS INTEGER) - 1 AS mi
  FROM v_claims"""

VIEWS["v_years"] = """
  SELECT DISTINCT substr(ym, 1, 4) AS year FROM v_months"""

VIEWS["v_snapshots"] = """
  SELECT p.npi, m.ym, m.mi, p.k, p.a, p.zip5, p.county_fips
  FROM v_provider p CROSS JOIN v_months m
  WHERE p.k % 37 <> 5
    AND NOT (p.k % 13 = 3 AND m.mi % 5 <> 0)
    AND NOT (p.k % 13 = 4 AND m.mi % 30 <> 0)
    AND (7 * p.k + m.mi) % 11 <> 0"""

VIEWS["v_dental"] = """
  SELECT * FROM v_claims WHERE starts_with(code, 'D')"""

VIEWS["v_merged"] = """
  SELECT d.servicing_id, d.code, d.year_month, d.benef, d.claims, d.paid,
         s.k, s.a, s.county_fips,
         CASE d.benef % 3 WHEN 0 THEN CAST(s.a AS VARCHAR) || ' main  st'
                          WHEN 1 THEN CAST(s.a AS VARCHAR) || ' MAIN ST '
                          ELSE CAST(s.a AS VARCHAR) || ' Main St' END AS practice_address_line_1,
         CASE s.a % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'Suite ' || CAST(s.a AS VARCHAR) END
           AS practice_address_line_2,
         'City ' || CAST(s.a % 25 AS VARCHAR) AS practice_city,
         'S' || CAST(s.a % 7 AS VARCHAR) AS practice_state,
         s.zip5 AS practice_zip5
  FROM v_dental d JOIN v_snapshots s ON d.servicing_id = s.npi AND d.year_month = s.ym"""


def norm_sql(x: str) -> str:
    """X7 in DuckDB: NULL -> '', upper, whitespace runs -> one space, trimmed."""
    return f"trim(regexp_replace(upper(coalesce({x}, '')), '\\s+', ' ', 'g'))"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


ADDR = ["practice_address_line_1", "practice_address_line_2", "practice_city",
        "practice_state", "practice_zip5"]


def address_id_sql(prefix: str = "") -> str:
    return "md5(" + " || '|' || ".join(norm_sql(prefix + c) for c in ADDR) + ")"


def address_full_sql(prefix: str = "") -> str:
    p = {c: strip_sql(f"coalesce({prefix}{c}, '')") for c in ADDR}
    l1, l2 = p[ADDR[0]], p[ADDR[1]]
    first = f"(CASE WHEN {l2} = '' THEN {l1} ELSE {l1} || ' ' || {l2} END)"
    full = f"{first} || ', ' || {p[ADDR[2]]} || ', ' || {p[ADDR[3]]} || ' ' || {p[ADDR[4]]}"
    return strip_sql(f"regexp_replace({full}, '\\s+', ' ', 'g')")


VIEWS["v_geocoded"] = f"""
  SELECT g.address_id,
         CASE WHEN g.a % 14 = 0 THEN 'U' WHEN g.a % 22 = 2 THEN 'T' ELSE 'M' END AS geocode_status,
         CASE WHEN g.a % 14 = 0 THEN NULL ELSE p.county_fips END AS county_fips,
         CASE WHEN g.a % 14 = 0 THEN NULL ELSE 'County ' || p.county_fips END AS county_name,
         CASE WHEN g.a % 14 = 0 OR g.a % 50 = 16 THEN NULL ELSE CAST(25 + g.a % 24 AS DOUBLE) END AS latitude,
         CASE WHEN g.a % 14 = 0 THEN NULL ELSE CAST(-120 + g.a % 50 AS DOUBLE) END AS longitude,
         CAST(g.rows + CASE WHEN g.a % 26 = 4 THEN 1 ELSE 0 END AS BIGINT) AS n_rows,
         g.address_full
  FROM (SELECT a, count(*) AS rows, min({address_id_sql()}) AS address_id,
               min({address_full_sql()}) AS address_full
        FROM v_merged GROUP BY a) g
  LEFT JOIN v_provider p ON p.k = g.a
  WHERE g.a % 30 <> 8
  UNION ALL
  SELECT 'unused-1', 'M', NULL, NULL, 25.0, -120.0, CAST(1 AS BIGINT), 'UNUSED'"""

_cells = ",\n         ".join(
    f"CASE WHEN p.k % 43 = 1 AND {i} = 3 THEN 'N/A'"
    f" WHEN (p.k + y.y + {i}) % 19 = 0 THEN '-666666666'"
    f" ELSE CAST((7 * p.k + {13 * i} + y.y) % 200 AS VARCHAR) END AS e{i}" for i in range(1, 7))
_margins = ", ".join(f"CAST((p.k + {i}) % 40 AS VARCHAR) AS m{i}" for i in range(1, 7))

VIEWS["v_survey"] = f"""
  SELECT CAST(y.y AS VARCHAR) AS year, p.county_fips AS geoid, p.k,
         {_cells},
         {_margins}
  FROM v_provider p CROSS JOIN (SELECT CAST(year AS INTEGER) AS y FROM v_years) y
  WHERE p.county_fips IS NOT NULL"""


def _enroll(key: str) -> str:
    return f"""
  SELECT p.{key} AS region_id, CAST(y.y AS VARCHAR) AS year,
         CAST(sum(CASE WHEN p.k % 23 = 6 THEN 0 ELSE 200 + (31 * p.k + 17 * (y.y - 1995)) % 900 END)
              AS BIGINT) AS medicaid_enrollees
  FROM v_provider p CROSS JOIN (SELECT CAST(year AS INTEGER) AS y FROM v_years) y
  WHERE p.{key} IS NOT NULL AND p.k % 17 <> 0
  GROUP BY 1, 2"""


VIEWS["v_enroll_county"] = _enroll("county_fips")
VIEWS["v_enroll_zcta"] = _enroll("zip5")

_fips = ", ".join(f"('{k}', '{v}')" for k, v in __import__(
    "claimgeo.functions.constants", fromlist=["x"]).STATE_FIPS_TO_POSTAL.items())
VIEWS["fips_map"] = f"""
  SELECT * FROM (VALUES {_fips}) t(state_fips, postal)"""

_ranges = ", ".join(f"({lo}, {hi}, '{lab}')" for lo, hi, lab in __import__(
    "claimgeo.functions.constants", fromlist=["x"]).CATEGORY_RANGES)
VIEWS["cat_ranges"] = f"""
  SELECT * FROM (VALUES {_ranges}) t(lo, hi, label)"""

_K = __import__("claimgeo.functions.constants", fromlist=["x"])
_layers = ", ".join(f"('{c}', '{k}', '{_K.LAYER_LABELS[k]}')" for c, k in _K.CATEGORY_TO_LAYER.items())
VIEWS["layer_map"] = f"""
  SELECT * FROM (VALUES {_layers}) t(category, layer, label)"""
_names = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in _K.STATE_POSTAL_TO_NAME.items())
VIEWS["state_names"] = f"""
  SELECT * FROM (VALUES {_names}) t(postal, state_name)"""

# Categorised base, one row per merged claim row.
VIEWS["v_base"] = """
  SELECT NULLIF(b.county_fips, '') AS county_fips,
         m.postal AS state,
         substr(NULLIF(trim(b.practice_zip5), ''), 1, 3) AS zip3,
         b.year_month,
         substr(b.year_month, 1, 4) AS year,
         coalesce((SELECT r.label FROM cat_ranges r
                   WHERE CASE WHEN regexp_full_match(b.code, 'D[0-9]{4}')
                              THEN CAST(substr(b.code, 2, 4) AS INTEGER) END BETWEEN r.lo AND r.hi),
                  'Uncategorized') AS category,
         b.benef, b.claims, b.paid
  FROM v_merged b LEFT JOIN fips_map m ON substr(NULLIF(b.county_fips, ''), 1, 2) = m.state_fips"""

ORDER = list(VIEWS)


def with_views(sql: str, extra: dict[str, str] | None = None) -> str:
    """``WITH <all views>[, extra...] <sql>``."""
    parts = [f"{name} AS ({body}\n)" for name, body in VIEWS.items()]
    for name, body in (extra or {}).items():
        parts.append(f"{name} AS ({body}\n)")
    body = sql.lstrip()
    if body[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(parts) + ",\n" + body[5:]
    return "WITH " + ",\n".join(parts) + "\n" + sql
