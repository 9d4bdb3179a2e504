"""Queries through the text sources and sinks (S1, S2, S8-S10, K3, K5, K6, K8,
J4, J9, A19, A20, F9): the bindings are written as files, with shuffled
columns and awkward values, and read back by the library's readers.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import aggregate as A
from ..operators import denominators as D
from ..operators import export as E
from ..operators import geocode as G
from ..operators import rates as R
from ..operators import snapshot as S
from ..session import checkpoint_dir, room_for
from ..sources import bucketed as B
from ..sources import csv as C
from ..sources import publish as P
from ..sources import readers as RD
from ..sources import sinks as SK
from .catalog import bind, register
from .oracle_views import with_views
from .q_aggregate import SUMS_SQL, base
from .q_rates import _LAYERED, _SUBSET_SQL, _agg_cte, _rate


def scratch(spark, name: str) -> str:
    """A new folder in the shared checkpoint location."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@register("claims_scan", with_views("""
SELECT servicing_id, code, year_month,
       regexp_replace(year_month, '[^0-9]', '', 'g')[1:6] AS ym,
       benef, claims, paid
FROM v_claims"""))
def claims_scan(spark, sf):
    """S1 + X1: claim rows written as CSV in another column order, read by name."""
    names = {dst: src for src, dst in K.CLAIMS_COLUMNS.items()}
    path = scratch(spark, "claims-csv")
    raw = bind(spark, sf).claims.withColumn("billing_id", F.lit("1000000000"))
    C.write_csv_files(raw.select(*[F.col(c).alias(names[c]) for c in
                                   ("paid", "year_month", "billing_id", "claims", "servicing_id", "benef", "code")]), path)
    return RD.read_claims(spark, path).select("servicing_id", "code", "year_month", "ym", "benef", "claims", "paid")


@register("snapshot_scan", with_views("""
SELECT npi, replace(ym, '-', '') AS ym, 'Line "' || npi || '", 1' AS practice_address_line_1, '  Suite 2' AS practice_address_line_2,
       'City' AS practice_city, 'S1' AS practice_state, zip5 AS practice_zip5, 'US' AS practice_country_code,
       CASE WHEN CAST(right(ym, 1) AS INTEGER) % 2 = 1 THEN 'B' END AS primary_taxonomy_code
FROM v_snapshots"""))
def snapshot_scan(spark, sf):
    """S2 + S4 + T3: monthly registry files with two different headers; the
    month comes from the file name."""
    a = K.SNAPSHOT_ADDRESS_COLUMNS
    code, switch = K.SNAPSHOT_TAXONOMY_CODE_PREFIX, K.SNAPSHOT_TAXONOMY_SWITCH_PREFIX
    snaps = bind(spark, sf).snapshots.select(
        F.col("npi").alias("NPI"), F.concat(F.lit('Line "'), "npi", F.lit('", 1')).alias(a[0]), F.lit("  Suite 2").alias(a[1]),
        F.lit("City").alias(a[2]), F.lit("S1").alias(a[3]), F.col("zip5").alias(a[4]),
        F.lit("US").alias(K.SNAPSHOT_COUNTRY_PREFIX), F.lit("A").alias(code + "1"), F.lit("N").alias(switch + "1"),
        F.lit("B").alias(code + "2"), F.lit("Y").alias(switch + "2"), "ym")
    odd = F.substring("ym", 7, 1).cast("int") % 2 == 1
    old = snaps.filter(odd).select("ym", "NPI", *[F.col(f"`{c}`") for c in reversed(snaps.columns[1:-1])])
    new = snaps.filter(~odd).drop(code + "2", switch + "2")
    paths = []
    for name, df in (("old", old), ("new", new)):
        path = scratch(spark, f"registry-{name}")
        months = F.concat(F.lit("npi_raw_"), F.regexp_replace("ym", "-", ""))
        df.withColumn("file", months).drop("ym").repartition("file").write.partitionBy("file").options(**C.WRITE).csv(path)
        paths.append(path)
    # The writer names the folder by month, not the file: the reader takes it from the path.
    old, new = (RD.read_snapshots(spark, f"{path}/*/*.csv", in_path=True) for path in paths)
    return RD.snapshot_table(old.unionByName(new, allowMissingColumns=True))


@register("geocoded_scan", with_views("""
SELECT address_id, geocode_status, county_fips, county_name, latitude, longitude FROM v_geocoded"""))
def geocoded_scan(spark, sf):
    """S6 + W6 + X4: the geocoder reply as CSV files that open with a byte
    order mark, in another column order with a further column, county codes
    without their leading zero, delivered twice: the first delivery counts."""
    path = scratch(spark, "reply-csv")
    geo = bind(spark, sf).geocoded
    once = geo.withColumn("delivery", F.lit(1))
    again = geo.withColumns({"delivery": F.lit(2), "geocode_status": F.lit("T"), "latitude": F.lit(0.0)})
    both = once.unionByName(again).orderBy("delivery", "address_id")
    C.write_csv_files(both.select(
        F.col("address_id").alias("\ufeffaddress_id"), F.col("longitude").alias("Longitude"), F.col("latitude").alias("Latitude"),
        F.col("geocode_status").alias("Status"), F.col("address_full").alias("Address, as sent"),
        F.regexp_replace("county_fips", "^0", "").alias("CountyFIPS"), F.col("county_name").alias("CountyNAME")), path)
    return G.read_geocoded(spark, path)


_SIX = " UNION ALL ".join(
    f"SELECT '{period}' AS grain, '{level}' AS level, {key} AS key, {period} AS period, category, {SUMS_SQL} "
    f"FROM v_base WHERE {key} IS NOT NULL GROUP BY ALL"
    for period in ("year", "year_month") for level, key in A.LEVEL_KEYS.items())


@register("geo_claims_aggregate", with_views(_SIX))
def geo_claims_aggregate(spark, sf):
    """S8 + A1: the geocoded claims CSV (ids and codes as text, county codes
    without their leading zero) read back and rolled up to all six outputs."""
    path = scratch(spark, "geo-claims-csv")
    columns = {"servicing_npi": "servicing_id", "hcpcs_code": "code", "year_month": "year_month",
               "beneficiaries_served_count": "benef", "claims_count": "claims", "total_amount_paid": "paid",
               **{c: c for c in K.MERGED_COLUMNS if c.startswith("practice_") and c != "practice_country_code"}}
    rows = bind(spark, sf).merged.select(
        F.regexp_replace("county_fips", "^0", "").alias("county_fips"),
        *[F.col(have).alias(name) for name, have in reversed(columns.items())],
        *[F.lit(None).cast("string").alias(c) for c in K.MERGED_COLUMNS if c not in columns])
    C.write_csv_files(rows, path)
    claims = A.categorised_base(RD.read_geo_claims(spark, path), A.fips_dimension(spark))
    return A.multi_level_aggregate(claims, A.LEVEL_KEYS, ("year", "year_month")).select(
        "grain", "level", "key", "period", "category", "total_beneficiaries_served", "total_claims", "total_amount_paid")


@register("enrollment_scan", with_views("""
SELECT region_id, year, medicaid_enrollees FROM v_enroll_county"""))
def enrollment_scan(spark, sf):
    """S9 + X4: the county panel as CSV with further columns, in the survey's
    order, ids without their leading zero."""
    path = scratch(spark, "enrollment-csv")
    b = bind(spark, sf).enroll_county
    C.write_csv_files(b.select("year", F.regexp_replace("region_id", "^0", "").alias("geoid"), F.lit('A "county", ST').alias("name"),
                               F.col("medicaid_enrollees"), F.lit(None).cast("string").alias("note")), path)
    return D.read_enrollment(spark, path)


@register("matrix_scan", with_views("""
SELECT region_id AS geoid, CAST(medicaid_enrollees AS VARCHAR) AS estimate, year FROM v_enroll_county"""))
def matrix_scan(spark, sf):
    """API replies, one per county, whose headers are ordered in two ways."""
    b = bind(spark, sf).enroll_county
    row = [F.col("region_id"), F.col("medicaid_enrollees").cast("string"), F.col("year")]
    head = [F.lit(c) for c in ("geoid", "estimate", "year")]
    straight = F.col("region_id") < "2"
    docs = b.groupBy("region_id").agg(F.to_json(F.concat(
        F.when(straight, F.array(F.array(*head))).otherwise(F.array(F.array(*head[::-1]))),
        F.collect_list(F.when(straight, F.array(*row)).otherwise(F.array(*row[::-1]))))).alias("value"))
    return D.matrix_to_table(docs, ["geoid", "estimate", "year"])


@register("csv_roundtrip", with_views("""
SELECT servicing_id, '  "' || code || '", ' AS note, CASE WHEN benef % 2 = 0 THEN 'a, b' END AS list, claims::VARCHAR AS claims
FROM v_dental"""))
def csv_roundtrip(spark, sf):
    """K5/K6/K8: quotes, commas, blanks and NULLs through the CSV sink and back."""
    path = scratch(spark, "csv")
    rows = bind(spark, sf).dental.select(
        "servicing_id", F.concat(F.lit('  "'), "code", F.lit('", ')).alias("note"),
        F.when(F.col("benef") % 2 == 0, "a, b").alias("list"), "claims")
    SK.write_csv(rows, path, ["servicing_id", "note", "list", "claims"], ["servicing_id"])
    return C.read_csv(spark, path, ["note", "servicing_id", "claims", "list"])


_ENROLL_LINES = """
SELECT region_id AS key, '{' || to_json(region_id) || ':' || to_json(list({year: year, medicaid_enrollees: medicaid_enrollees}
       ORDER BY year)) || '}' AS line, CAST(count(*) AS BIGINT) AS n_records
FROM v_enroll_county GROUP BY region_id"""


@register("enrollment_ndjson", with_views(_ENROLL_LINES))
def enrollment_ndjson(spark, sf):
    """K3: enrollment records as keyed NDJSON lines."""
    b = bind(spark, sf).enroll_county
    return A.ndjson_lines(b.select(F.col("region_id").alias("key"), F.col("year").alias("period"), "medicaid_enrollees"),
                          fields=A.ENROLLMENT_FIELDS)


@register("enrollment_ndjson_roundtrip", with_views("""
SELECT left(region_id, 3) AS key, year AS period, CAST(sum(medicaid_enrollees) AS BIGINT) AS medicaid_enrollees
FROM v_enroll_zcta GROUP BY ALL"""))
def enrollment_ndjson_roundtrip(spark, sf):
    """K3 + S11: the ZIP3 enrollment output written and read back."""
    path = scratch(spark, "enrollment-ndjson")
    z = D.enrollment_by(bind(spark, sf).enroll_zcta, "zip3")
    lines = A.ndjson_lines(z.select(F.col("region_id").alias("key"), F.col("year").alias("period"), "medicaid_enrollees"),
                           fields=A.ENROLLMENT_FIELDS)
    lines.select("line").write.text(path)
    return RD.read_keyed_ndjson(spark, path, fields=A.ENROLLMENT_FIELDS)


@register("enrollment_county", with_views("SELECT region_id, year, medicaid_enrollees FROM v_enroll_county"))
def enrollment_county(spark, sf):
    """The county output."""
    return D.enrollment_by(bind(spark, sf).enroll_county, "county")


@register("enrollment_unmapped", with_views("""
SELECT left(region_id, 2) AS prefix, CAST(count(*) AS BIGINT) AS n_rows
FROM v_enroll_county WHERE left(region_id, 2) NOT IN (SELECT state_fips FROM fips_map) GROUP BY 1"""))
def enrollment_unmapped(spark, sf):
    """The prefixes without a state, which the strict roll-up raises on."""
    j = A.attach_parent(bind(spark, sf).enroll_county, "region_id", A.fips_dimension(spark), alias="parent")
    return (j.filter("parent IS NULL").groupBy(F.substring("region_id", 1, 2).alias("prefix"))
            .agg(F.count(F.lit(1)).alias("n_rows")))


@register("region_value_universe", with_views("""
SELECT u.region_id AS key, '1995' AS period, 'preventive' AS layer, coalesce(l.total_claims, 0) AS total_claims,
       e.medicaid_enrollees,
       CASE WHEN e.medicaid_enrollees > 0 THEN CAST(coalesce(l.total_claims, 0) AS DOUBLE) / e.medicaid_enrollees END AS value
FROM (SELECT DISTINCT county_fips AS region_id FROM v_provider WHERE county_fips IS NOT NULL) u
LEFT JOIN (SELECT * FROM layered WHERE period = '1995' AND layer = 'preventive') l ON l.key = u.region_id
LEFT JOIN v_enroll_county e ON e.region_id = u.region_id AND e.year = '1995'""",
    {"agg": _agg_cte("county_fips", "year"), "layered": _LAYERED}))
def region_value_universe(spark, sf):
    """Every county of the registry for one year and layer: 0 without
    records, no rate without a denominator."""
    b = bind(spark, sf)
    every = b.provider.select(F.col("county_fips").alias("key")).filter("key IS NOT NULL").distinct()
    agg = A.category_aggregate(base(spark, sf), "county_fips", "year")
    return R.region_value(agg, "1995", "preventive", "enrollees", b.enroll_county, every)


@register("subset_export_named", with_views(
    _SUBSET_SQL.format(name="coalesce(n.name, l.key)", level="county", rate=_rate("total_claims", "e.medicaid_enrollees"),
                       denom="(SELECT e.*, NULL AS unused FROM v_enroll_county e)", cats="'preventive', 'diagnostic'",
                       all_clause="").replace(
        "WHERE (l.layer", "LEFT JOIN names n ON n.region_id = l.key WHERE l.key < '30' AND l.period IN ('1994', '1996') AND (l.layer"),
    {"agg": _agg_cte("county_fips", "year"), "layered": _LAYERED,
     "names": "SELECT DISTINCT county_fips AS region_id, 'County \"' || county_fips || '\", ' || left(county_fips, 2) AS name "
              "FROM v_provider WHERE county_fips IS NOT NULL AND right(county_fips, 1) <> '1'"}))
def subset_export_named(spark, sf):
    """A23 + F9 + J9: chosen counties (a DataFrame of ids), years and layers,
    with county names where the dimension has one."""
    b = bind(spark, sf)
    ids = b.provider.select(F.col("county_fips").alias("region_id")).filter("region_id IS NOT NULL").distinct()
    names = ids.filter(~F.col("region_id").endswith("1")).select("region_id", F.concat(
        F.lit('County "'), "region_id", F.lit('", '), F.substring("region_id", 1, 2)).alias("name"))
    agg = A.category_aggregate(base(spark, sf), "county_fips", "year")
    return E.subset_export(agg, "county", b.enroll_county, ["1994", "1996"], ["preventive", "diagnostic"],
                           ids.filter("region_id < '30'"), county_names=names)


_GRAINS = " UNION ALL ".join(
    f"SELECT '{p}' AS grain, '{level}' AS level, {k} AS key, {p} AS period, category, sum(claims) c, sum(benef) b, sum(paid) p "
    f"FROM v_base WHERE {k} IS NOT NULL GROUP BY {k}, {p}, category"
    for p in ("year", "year_month") for level, k in A.LEVEL_KEYS.items())


@register("published_outputs", with_views("""
SELECT grain, level, key, period, category, CAST(b AS BIGINT) AS total_beneficiaries_served, CAST(c AS BIGINT) AS total_claims,
       CAST(p AS DECIMAL(38,2)) AS total_amount_paid FROM grains""", {"grains": _GRAINS}))
def published_outputs(spark, sf):
    """K4 + K3 + A3: the six outputs written, audited on the stored files,
    published by a rename, and read from where users find them."""
    target = scratch(spark, "outputs")
    P.publish_outputs(base(spark, sf), target, A.fips_dimension(spark))
    return P.read_outputs(spark, target)


@register("published_audit", with_views("""
SELECT level, "check", CAST(n_bad AS BIGINT) AS n_bad, n_bad = 0 AS ok FROM (
  SELECT level, 'one_line_a_key' AS "check", sum(n - 1) AS n_bad
  FROM (SELECT level, grain, key, count(DISTINCT key) AS n FROM grains GROUP BY ALL) GROUP BY level
  UNION ALL
  SELECT level, 'grain_unique', sum(n - 1)
  FROM (SELECT grain, level, count(*) AS n FROM grains GROUP BY grain, level, key, period, category) GROUP BY level
  UNION ALL
  SELECT level, 'annual_is_months', count(*) FILTER (y.c IS DISTINCT FROM m.c OR y.b IS DISTINCT FROM m.b OR y.p IS DISTINCT FROM m.p)
  FROM (SELECT * FROM grains WHERE grain = 'year') y
  FULL JOIN (SELECT level, key, left(period, 4) AS period, category, sum(c) c, sum(b) b, sum(p) p
             FROM grains WHERE grain = 'year_month' GROUP BY 1, 2, 3, 4) m USING (level, key, period, category)
  GROUP BY level
  UNION ALL
  SELECT 'state', 'state_is_counties', count(*) FILTER (s.c IS DISTINCT FROM k.c OR s.b IS DISTINCT FROM k.b OR s.p IS DISTINCT FROM k.p)
  FROM (SELECT * FROM grains WHERE level = 'state') s
  FULL JOIN (SELECT grain, postal AS key, period, category, sum(c) c, sum(b) b, sum(p) p
             FROM grains JOIN fips_map ON state_fips = left(key, 2) WHERE level = 'county' GROUP BY ALL) k
  USING (grain, key, period, category))""", {"grains": _GRAINS}))
def published_audit(spark, sf):
    """A3: the checks of the six outputs as stored, before they are published."""
    return P.publish_outputs(base(spark, sf), scratch(spark, "outputs"), A.fips_dimension(spark))


def bucketed_inputs(spark, sf, rows_a_bucket: int = 2_000_000):
    """Claims and registry of the fixture as tables bucketed by id in each
    month, with as many buckets as their rows ask for."""
    b = bind(spark, sf)
    rows = b.claims.count()
    room_for(spark, rows)
    buckets = B.buckets_for_rows(rows + b.snapshots.count(), rows_a_bucket)
    tables = []
    for name, df, key, month in (("claims", b.claims, "servicing_id", "year_month"), ("registry", b.snapshots, "npi", "ym")):
        table = f"claimgeo_{name}_{uuid.uuid4().hex}"
        B.write_bucketed(df, table, scratch(spark, f"bucketed-{name}"), key, month, buckets)
        tables.append(spark.table(table))
    return tables


@register("snapshot_join_bucketed", with_views("""
SELECT c.servicing_id, c.year_month, c.code, c.claims, s.zip5, s.county_fips
FROM v_claims c, v_snapshots s
WHERE c.code LIKE 'D%' AND s.npi = c.servicing_id AND s.ym = c.year_month"""))
def snapshot_join_bucketed(spark, sf):
    """J1 + S5 + K1: the same-month join over tables bucketed by id, without an exchange."""
    claims, registry = bucketed_inputs(spark, sf)
    j = B.bucketed_snapshot_join(S.filter_code_prefix(claims), registry)
    return j.select("servicing_id", "year_month", "code", "claims", "zip5", "county_fips")


@register("outputs_from_buckets", with_views("""
SELECT grain, level, key, period, category, CAST(b AS BIGINT) AS total_beneficiaries_served, CAST(c AS BIGINT) AS total_claims,
       CAST(p AS DECIMAL(38,2)) AS total_amount_paid FROM grains""", {"grains": _GRAINS}))
def outputs_from_buckets(spark, sf):
    """A1 + K4 over the bucketed join: all six outputs, whose only exchanges are those of the sums."""
    claims, registry = bucketed_inputs(spark, sf)
    merged = bind(spark, sf).addressed(B.bucketed_snapshot_join(S.filter_code_prefix(claims), registry))
    return A.multi_level_aggregate(A.categorised_base(merged, A.fips_dimension(spark)), periods=("year", "year_month"))
