"""Queries of addresses, geocoding, geometry and scalar functions
(A5, A6, A13–A15, A28, O1, J2, J10, J11, Q1, Q2, S6, W6, G1–G5, F10, X1–X12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import scalars as X
from ..operators import address as AD
from ..operators import geocode as G
from ..operators import geometry as GM
from ..operators import quality as Q
from .catalog import bind, register
from .oracle_views import ADDR, address_full_sql, address_id_sql, norm_sql, with_views


def _geo(spark, sf):
    b = bind(spark, sf)
    claims = G.with_address_id(b.merged, AD.ADDRESS_PARTS)
    return b, claims, b.geocoded


# ---- addresses ------------------------------------------------------------------

_DEDUP_SQL = f"""
SELECT md5({" || '|' || ".join(f"n{i}" for i in range(5))}) AS address_id,
       {address_full_sql()} AS address_full,
       {", ".join(ADDR)},
       CAST(n_rows AS BIGINT) AS n_rows, CAST(n_claims AS BIGINT) AS n_claims,
       CAST(total_paid AS DECIMAL(38,2)) AS total_paid
FROM (SELECT {", ".join(f"{norm_sql(c)} AS n{i}" for i, c in enumerate(ADDR))},
             count(*) AS n_rows, sum(claims) AS n_claims, sum(paid) AS total_paid,
             {", ".join(f"min({c}) AS {c}" for c in ADDR)}
      FROM v_merged GROUP BY ALL)"""


@register("address_dedup", with_views(_DEDUP_SQL))
def address_dedup(spark, sf):
    """A5 + X7–X9: one row per normalised practice address."""
    return AD.dedupe_addresses(bind(spark, sf).merged)


@register("top_addresses", with_views(
    "SELECT address_id, n_claims, n_rows FROM ad", {"ad": _DEDUP_SQL}))
def top_addresses(spark, sf):
    """O1: every address in priority order."""
    return AD.top_addresses(AD.dedupe_addresses(bind(spark, sf).merged)).select("address_id", "n_claims", "n_rows")


@register("address_concentration", with_views("""
SELECT CAST(count(*) AS BIGINT) AS n_addresses, CAST(sum(n_rows) AS BIGINT) AS n_rows,
       round(sum(n_rows) / count(*), 6) AS reduction_factor,
       round(100.0 * sum(n_claims) FILTER (WHERE rk <= greatest(1, floor(n * 1 / 100))) / sum(n_claims), 6)
         AS top1_pct,
       round(100.0 * sum(n_claims) FILTER (WHERE rk <= greatest(1, floor(n * 10 / 100))) / sum(n_claims), 6)
         AS top10_pct
FROM (SELECT *, row_number() OVER (ORDER BY n_claims DESC, address_id) AS rk, count(*) OVER () AS n FROM ad)""",
    {"ad": _DEDUP_SQL}))
def address_concentration(spark, sf):
    """Share of claims at the top 1 % / 10 % of addresses."""
    return AD.concentration(AD.dedupe_addresses(bind(spark, sf).merged))


# ---- geocoding ------------------------------------------------------------------

_SEEN = f"SELECT {address_id_sql()} AS address_id, count(*) AS n_claim_rows FROM v_merged GROUP BY 1"


@register("geocode_join", with_views(f"""
SELECT {address_id_sql('m.')} AS address_id, m.year_month, m.servicing_id, m.claims,
       g.geocode_status, g.county_fips, g.latitude, g.longitude
FROM v_merged m LEFT JOIN v_geocoded g ON g.address_id = {address_id_sql('m.')}"""))
def geocode_join(spark, sf):
    """Claim rows enriched with the geocoder reply by address id."""
    b = bind(spark, sf)
    j = G.geocode_join_by_dictionary(b.merged, b.geocoded, AD.ADDRESS_PARTS)
    return j.select("address_id", "year_month", "servicing_id", "claims", "geocode_status", "county_fips",
                    "latitude", "longitude")


@register("geocode_dedup", with_views("""
SELECT address_id, geocode_status, county_fips, county_name, latitude, longitude, n_rows, address_full
FROM (SELECT *, 1 AS delivery FROM v_geocoded
      UNION ALL SELECT address_id, 'T', county_fips, county_name, latitude, longitude, n_rows + 100, address_full, 2
      FROM v_geocoded)
QUALIFY row_number() OVER (PARTITION BY address_id ORDER BY delivery) = 1"""))
def geocode_dedup(spark, sf):
    """S6 + W6: a reply delivered twice reduced to the first row per id."""
    geo = bind(spark, sf).geocoded
    dup = (geo.withColumn("delivery", F.lit(1))
              .unionByName(geo.withColumn("geocode_status", F.lit("T"))
                              .withColumn("n_rows", F.col("n_rows") + 100).withColumn("delivery", F.lit(2))))
    return G.keep_first(dup, "address_id", ["delivery"]).drop("delivery")


@register("status_counts", with_views(
    "SELECT geocode_status, CAST(count(*) AS BIGINT) AS n FROM v_geocoded GROUP BY 1"))
def status_counts(spark, sf):
    """Reply rows per geocode status (NULL kept)."""
    return Q.value_counts(bind(spark, sf).geocoded, "geocode_status")


@register("geocode_summary", with_views(f"""
SELECT (SELECT CAST(count(*) AS BIGINT) FROM v_geocoded) AS n_addresses,
       (SELECT CAST(count(*) AS BIGINT) FROM v_geocoded WHERE latitude IS NULL OR longitude IS NULL) AS n_without_latlon,
       (SELECT CAST(count(*) AS BIGINT) FROM v_geocoded WHERE county_fips IS NULL) AS n_without_county,
       CAST(count(*) AS BIGINT) AS total_rows,
       CAST(count(*) FILTER (WHERE g.latitude IS NOT NULL AND g.longitude IS NOT NULL) AS BIGINT) AS located_rows,
       CAST(count(*) FILTER (WHERE g.latitude IS NULL OR g.longitude IS NULL) AS BIGINT) AS failed_rows,
       round(100.0 * count(*) FILTER (WHERE g.latitude IS NOT NULL AND g.longitude IS NOT NULL) / count(*), 6)
         AS located_pct,
       round(100.0 * count(*) FILTER (WHERE g.latitude IS NULL OR g.longitude IS NULL) / count(*), 6) AS failed_pct
FROM v_merged m LEFT JOIN v_geocoded g ON g.address_id = {address_id_sql('m.')}"""))
def geocode_summary(spark, sf):
    """A14 + F5: reply and claim-row located / failed counts."""
    _, claims, geo = _geo(spark, sf)
    return G.geocode_summary(geo, G.geocode_join(claims, geo))


_LEDGER_SQL = """
SELECT s.address_id, 'geocoder_unmatched' AS failure_reason, CAST(s.n_claim_rows AS BIGINT) AS n_claim_rows,
       g.geocode_status, g.address_full
FROM seen s JOIN v_geocoded g USING (address_id)
WHERE (g.latitude IS NULL OR g.longitude IS NULL) AND g.geocode_status = 'U'
UNION ALL
SELECT s.address_id, 'join_miss', CAST(s.n_claim_rows AS BIGINT), NULL, NULL
FROM seen s WHERE s.address_id NOT IN (SELECT address_id FROM v_geocoded)
UNION ALL
SELECT s.address_id, 'unexpected_missing_coords', CAST(s.n_claim_rows AS BIGINT), g.geocode_status, g.address_full
FROM seen s JOIN v_geocoded g USING (address_id)
WHERE (g.latitude IS NULL OR g.longitude IS NULL) AND g.geocode_status IS DISTINCT FROM 'U'"""


@register("geocode_ledger", with_views(_LEDGER_SQL, {"seen": _SEEN}))
def geocode_ledger(spark, sf):
    """Q1 + J10 + X19: per failed address, reason and claim rows."""
    _, claims, geo = _geo(spark, sf)
    return G.geocode_ledger(G.seen_counts(claims), geo)


@register("geocode_failure_totals", with_views("""
SELECT r.failure_reason, CAST(count(l.address_id) AS BIGINT) AS addresses,
       CAST(coalesce(sum(l.n_claim_rows), 0) AS BIGINT) AS claim_rows
FROM (VALUES ('geocoder_unmatched'), ('join_miss'), ('unexpected_missing_coords')) r(failure_reason)
LEFT JOIN ledger l USING (failure_reason) GROUP BY 1
UNION ALL SELECT 'TOTAL', CAST(count(*) AS BIGINT), CAST(coalesce(sum(n_claim_rows), 0) AS BIGINT) FROM ledger""",
    {"seen": _SEEN, "ledger": _LEDGER_SQL}))
def geocode_failure_totals(spark, sf):
    """Failures per reason with a total row."""
    _, claims, geo = _geo(spark, sf)
    return G.failure_totals(G.geocode_ledger(G.seen_counts(claims), geo))


@register("reconcile_n_rows", with_views("""
SELECT s.address_id, coalesce(g.n_rows, 0) AS expected_rows, CAST(coalesce(s.n_claim_rows, 0) AS BIGINT) AS actual_rows,
       coalesce(g.n_rows, 0) <> coalesce(s.n_claim_rows, 0) AS mismatch
FROM seen s JOIN v_geocoded g USING (address_id)""", {"seen": _SEEN}))
def reconcile_n_rows(spark, sf):
    """Expected against seen claim rows per geocoded address."""
    _, claims, geo = _geo(spark, sf)
    return G.reconcile_counts(G.seen_counts(claims), geo)


@register("geocode_gate", with_views("""
SELECT "check", n_bad, n_bad = 0 AS ok FROM (
  SELECT 'unused_geocoded' AS "check",
         (SELECT CAST(count(*) AS BIGINT) FROM v_geocoded WHERE address_id NOT IN (SELECT address_id FROM seen)) AS n_bad
  UNION ALL SELECT 'join_miss_rows', (SELECT CAST(coalesce(sum(n_claim_rows), 0) AS BIGINT) FROM ledger
                                      WHERE failure_reason = 'join_miss')
  UNION ALL SELECT 'unexpected_missing_rows', (SELECT CAST(coalesce(sum(n_claim_rows), 0) AS BIGINT) FROM ledger
                                               WHERE failure_reason = 'unexpected_missing_coords')
  UNION ALL SELECT 'n_rows_mismatch', (SELECT CAST(count(*) AS BIGINT) FROM seen s JOIN v_geocoded g USING (address_id)
                                       WHERE coalesce(g.n_rows, 0) <> s.n_claim_rows))
UNION ALL
SELECT 'all_checks', CAST(sum(n_bad) AS BIGINT), sum(n_bad) = 0 FROM (
  SELECT (SELECT count(*) FROM v_geocoded WHERE address_id NOT IN (SELECT address_id FROM seen)) AS n_bad
  UNION ALL SELECT (SELECT coalesce(sum(n_claim_rows), 0) FROM ledger WHERE failure_reason <> 'geocoder_unmatched')
  UNION ALL SELECT (SELECT count(*) FROM seen s JOIN v_geocoded g USING (address_id)
                    WHERE coalesce(g.n_rows, 0) <> s.n_claim_rows))""",
    {"seen": _SEEN, "ledger": _LEDGER_SQL}))
def geocode_gate(spark, sf):
    """Q2: the geocode integrity checks and the overall verdict."""
    _, claims, geo = _geo(spark, sf)
    return G.geocode_gate(G.seen_counts(claims), geo)


@register("loss_waterfall", with_views(f"""
SELECT stage_no, stage, rows,
       CAST(coalesce(lag(rows) OVER (ORDER BY stage_no) - rows, 0) AS BIGINT) AS dropped,
       round(coalesce(100.0 * (lag(rows) OVER (ORDER BY stage_no) - rows) / lag(rows) OVER (ORDER BY stage_no), 0), 6)
         AS dropped_pct
FROM (SELECT 0 AS stage_no, 'source' AS stage, (SELECT CAST(count(*) AS BIGINT) FROM v_claims) AS rows
      UNION ALL SELECT 1, 'code_filter', (SELECT count(*) FROM v_dental)
      UNION ALL SELECT 2, 'snapshot_join', (SELECT count(*) FROM v_merged)
      UNION ALL SELECT 3, 'geocoded', (SELECT count(*) FROM v_merged m JOIN v_geocoded g
                                       ON g.address_id = {address_id_sql('m.')}
                                       WHERE g.latitude IS NOT NULL AND g.longitude IS NOT NULL))"""))
def loss_waterfall(spark, sf):
    """Rows remaining and lost at each build stage."""
    b = bind(spark, sf)
    located = G.geocode_join_by_dictionary(b.snapshot_addresses, b.geocoded, AD.ADDRESS_PARTS)
    return Q.loss_waterfall_once(b.claims, located, F.col("code").startswith("D"), G.located())


# ---- geometry ---------------------------------------------------------------------

def _parts(spark, sf):
    e = bind(spark, sf).table("embeddings")
    return e.select("vec_id", "label", GM.rings_from_vector("embedding").alias("ring"))


_PTS = """
SELECT vec_id, label, i, np, CAST(embedding[2 * i + 1] AS DOUBLE) AS lon, CAST(embedding[2 * i + 2] AS DOUBLE) AS lat
FROM (SELECT vec_id, label, embedding, len(embedding) // 2 AS np,
             unnest(range(0, len(embedding) // 2)) AS i FROM embeddings)"""

_AREA = """
SELECT p.vec_id, p.label, CAST(any_value(p.np) + 1 AS INTEGER) AS n_points,
       CASE WHEN any_value(p.np) + 1 < 4 THEN 0.0 ELSE abs(sum(
         (p.lon * 111.32 * cos(radians(ml.m))) * (q.lat * 110.57)
         - (q.lon * 111.32 * cos(radians(ml.m))) * (p.lat * 110.57))) / 2 END AS area
FROM pts p
JOIN pts q ON q.vec_id = p.vec_id AND q.i = (p.i + 1) % p.np
JOIN (SELECT vec_id, (sum(lat) + any_value(lat) FILTER (WHERE i = 0)) / (any_value(np) + 1) AS m
      FROM pts GROUP BY vec_id) ml ON ml.vec_id = p.vec_id
GROUP BY p.vec_id, p.label"""


@register("ring_area", with_views("SELECT vec_id, label, n_points, round(area, 3) AS area_km2 FROM area",
                                  {"pts": _PTS, "area": _AREA}))
def ring_area(spark, sf):
    """G1: shoelace ring area in km2 of every part."""
    p = _parts(spark, sf)
    return p.select("vec_id", "label", F.size("ring").alias("n_points"),
                    F.round(GM.ring_area_km2("ring"), 3).alias("area_km2"))


@register("small_part_filter", with_views(
    f"SELECT vec_id, label, round(area, 3) AS area_km2 FROM area WHERE area >= {K.MIN_PART_KM2}",
    {"pts": _PTS, "area": _AREA}))
def small_part_filter(spark, sf):
    """Parts of at least 1500 km2."""
    p = GM.drop_small_parts(_parts(spark, sf), holes=None)
    return p.select("vec_id", "label", F.round(GM.ring_area_km2("ring"), 3).alias("area_km2"))


@register("simplify_rings", with_views(f"""
SELECT p.vec_id, p.label, CAST(count(*) + 1 AS INTEGER) AS n_points, round(sum(p.lon), 6) AS lon_sum
FROM pts p JOIN (SELECT DISTINCT vec_id, pos FROM (SELECT vec_id, lo AS pos FROM cuts UNION ALL SELECT vec_id, hi FROM cuts)) k
  ON k.vec_id = p.vec_id AND k.pos = p.i
GROUP BY p.vec_id, p.label""", {
    "pts": _PTS,
    "cuts": f"""
    WITH RECURSIVE seg(vec_id, lo, hi) AS (
        SELECT vec_id, 0::BIGINT, (any_value(np) - 1)::BIGINT FROM pts GROUP BY vec_id
        UNION ALL
        SELECT vec_id, CASE WHEN side = 0 THEN lo ELSE far END, CASE WHEN side = 0 THEN far ELSE hi END
        FROM (SELECT s.vec_id, s.lo, s.hi, arg_max(p.i, struct_pack(d := CASE
                       WHEN a.lon = b.lon AND a.lat = b.lat THEN sqrt(pow(p.lon - a.lon, 2) + pow(p.lat - a.lat, 2))
                       ELSE abs((b.lat - a.lat) * (p.lon - a.lon) - (b.lon - a.lon) * (p.lat - a.lat))
                            / sqrt(pow(b.lon - a.lon, 2) + pow(b.lat - a.lat, 2)) END, i := -p.i)) AS far,
                     max(CASE
                       WHEN a.lon = b.lon AND a.lat = b.lat THEN sqrt(pow(p.lon - a.lon, 2) + pow(p.lat - a.lat, 2))
                       ELSE abs((b.lat - a.lat) * (p.lon - a.lon) - (b.lon - a.lon) * (p.lat - a.lat))
                            / sqrt(pow(b.lon - a.lon, 2) + pow(b.lat - a.lat, 2)) END) AS dist
              FROM seg s JOIN pts a ON a.vec_id = s.vec_id AND a.i = s.lo JOIN pts b ON b.vec_id = s.vec_id AND b.i = s.hi
              JOIN pts p ON p.vec_id = s.vec_id AND p.i > s.lo AND p.i < s.hi
              GROUP BY s.vec_id, s.lo, s.hi) m CROSS JOIN (VALUES (0), (1)) sides(side)
        WHERE dist > {K.SIMPLIFY_TOL_DEG})
    SELECT vec_id, lo, hi FROM seg"""}))
def simplify_rings(spark, sf):
    """Douglas-Peucker (0.12 degrees) on every ring."""
    s = GM.simplify_rings(_parts(spark, sf))
    open_ring = F.slice("ring", 1, F.size("ring") - 1)
    return s.select("vec_id", "label", F.size("ring").alias("n_points"),
                    F.round(F.aggregate(open_ring, F.lit(0.0), lambda a, p: a + p["lon"]), 6).alias("lon_sum"))


# Rings whose coordinates end in the digit 5 after the third decimal (what
# looks like a tie in decimals is mostly none in binary), each with a hole of
# half its size.
_TIED = """
SELECT vec_id, label, i, np, ring, k * (floor(lon * 1000) / 1000 + 0.0005) AS lon, k * (floor(lat * 1000) / 1000 + 0.0005) AS lat
FROM pts, (VALUES (0, 1.0::DOUBLE), (1, 0.5::DOUBLE)) rings(ring, k)"""
_ROUNDED = {
    "pts": _PTS,
    "tied": _TIED,
    "rp": """SELECT vec_id, label, ring, i, CAST(format('{:.3f}', lon) AS DOUBLE) AS lon,
                    CAST(format('{:.3f}', lat) AS DOUBLE) AS lat
             FROM (SELECT vec_id, label, ring, i, lon, lat FROM tied
                   UNION ALL SELECT vec_id, label, ring, np, lon, lat FROM tied WHERE i = 0)""",
    "dd": """SELECT * FROM (SELECT *, lag(lon) OVER w AS plon, lag(lat) OVER w AS plat FROM rp
                            WINDOW w AS (PARTITION BY vec_id, ring ORDER BY i))
             WHERE plon IS NULL OR plon <> lon OR plat <> lat""",
    "closed": """SELECT vec_id, label, ring, i, lon, lat FROM dd
                 UNION ALL
                 SELECT f.vec_id, f.label, f.ring, 1000000, f.lon, f.lat FROM
                   (SELECT vec_id, label, ring, arg_min(lon, i) AS lon, arg_min(lat, i) AS lat,
                           arg_max(lon, i) AS llon, arg_max(lat, i) AS llat FROM dd GROUP BY ALL) f
                 WHERE f.lon <> f.llon OR f.lat <> f.llat""",
    "kept": "SELECT * FROM closed QUALIFY count(*) OVER (PARTITION BY vec_id, ring) >= 4",
}


def _tied_parts(spark, sf):
    def tie(c):
        return F.floor(c * 1000) / 1000 + 0.0005

    def scaled(k):
        return F.transform("ring", lambda p: F.struct((tie(p["lon"]) * k).alias("lon"), (tie(p["lat"]) * k).alias("lat")))
    return _parts(spark, sf).select("vec_id", "label", scaled(1.0).alias("ring"), F.array(scaled(0.5)).alias("holes"))


@register("round_rings", with_views("""
SELECT vec_id, CAST(count(*) FILTER (ring = 0) AS INTEGER) AS n_points, round(sum(lon) FILTER (ring = 0), 6) AS lon_sum,
       round(sum(lat) FILTER (ring = 0), 6) AS lat_sum, CAST(count(DISTINCT ring) - 1 AS INTEGER) AS n_holes,
       round(coalesce(sum(lon) FILTER (ring = 1), 0), 6) AS hole_lon_sum
FROM kept GROUP BY vec_id HAVING count(*) FILTER (ring = 0) > 0""", _ROUNDED))
def round_rings(spark, sf):
    """Rings and holes rounded to 3 decimals, repeats dropped, re-closed."""
    r = GM.round_rings(_tied_parts(spark, sf))

    def total(ring, axis):
        return F.aggregate(ring, F.lit(0.0), lambda a, p: a + p[axis])
    return r.select("vec_id", F.size("ring").alias("n_points"), F.round(total(F.col("ring"), "lon"), 6).alias("lon_sum"),
                    F.round(total(F.col("ring"), "lat"), 6).alias("lat_sum"), F.size("holes").alias("n_holes"),
                    F.round(F.aggregate("holes", F.lit(0.0), lambda a, h: a + total(h, "lon")), 6).alias("hole_lon_sum"))


@register("dissolve_parts", with_views(f"""
WITH rings AS (SELECT vec_id, label, ring, list([lon, lat] ORDER BY i) AS points FROM kept GROUP BY ALL),
polygons AS (SELECT vec_id, label, list(points ORDER BY ring) AS rings FROM rings GROUP BY ALL HAVING min(ring) = 0),
f AS (SELECT 'L' || p.label || '-' || (p.vec_id // 10) AS feature, min('Label ' || p.label) AS name, count(*) AS n_parts,
             round(sum(a.area), 3) AS total_area_km2, list(rings ORDER BY p.vec_id) AS polygons
      FROM polygons p JOIN area a USING (vec_id) WHERE a.area >= {K.MIN_PART_KM2} GROUP BY 1)
SELECT feature, name, CASE WHEN n_parts = 1 THEN 'Polygon' ELSE 'MultiPolygon' END AS geom_type,
       CAST(n_parts AS BIGINT) AS n_parts, total_area_km2,
       '{{"type":"' || CASE WHEN n_parts = 1 THEN 'Polygon' ELSE 'MultiPolygon' END || '","coordinates":'
       || CASE WHEN n_parts = 1 THEN to_json(polygons[1])::VARCHAR ELSE to_json(polygons)::VARCHAR END || '}}' AS geometry
FROM f""", {**_ROUNDED, "area": _AREA}))
def dissolve_parts(spark, sf):
    """Large parts of a feature (a label's run of ten ids) as GeoJSON."""
    area = _parts(spark, sf).select("vec_id", GM.ring_area_km2("ring").alias("area_km2"))
    p = GM.round_rings(_tied_parts(spark, sf)).join(area, "vec_id").filter(F.col("area_km2") >= K.MIN_PART_KM2)
    label = F.col("label").cast("string")
    p = p.withColumn("feature", F.concat(F.lit("L"), label, F.lit("-"), F.floor(F.col("vec_id") / 10).cast("string"))) \
         .withColumn("name", F.concat(F.lit("Label "), label))
    return GM.dissolve(p, "feature", "vec_id", attributes=("name",))


@register("parent_exclusion", with_views("""
WITH rec AS (SELECT 'R' || r_regionkey AS key, r_name AS code, NULL AS parent FROM region
             UNION ALL SELECT 'N' || n_nationkey, n_name, 'R' || n_regionkey FROM nation)
SELECT key, code, parent FROM rec
WHERE code NOT IN ('AMERICA', 'CHINA')
  AND (parent IS NULL OR parent NOT IN (SELECT key FROM rec WHERE code IN ('AMERICA', 'CHINA')))"""))
def parent_exclusion(spark, sf):
    """records excluded by code or by their parent's code."""
    b = bind(spark, sf)
    reg = b.table("region").select(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("key"),
                                   F.col("r_name").alias("code"), F.lit(None).cast("string").alias("parent"))
    nat = b.table("nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("key"),
                                   F.col("n_name").alias("code"),
                                   F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("parent"))
    return GM.exclude_with_parent(reg.unionByName(nat), "key", "code", "parent", ["AMERICA", "CHINA"])


# ---- scalar functions over table columns ---------------------------------------------

_MIDX = "(CAST(substr(r, 1, 4) AS INTEGER) * 12 + CAST(substr(r, 5, 2) AS INTEGER) - 1)"


def _fmt_idx(e: str) -> str:
    return f"(lpad(CAST(({e}) // 12 AS VARCHAR), 4, '0') || lpad(CAST(({e}) % 12 + 1 AS VARCHAR), 2, '0'))"


@register("month_normalize", with_views(f"""
SELECT ym, r AS yyyymm, substr(r, 1, 4) || '-' || substr(r, 5, 2) AS dashed, {_MIDX} AS month_index,
       {_fmt_idx(_MIDX + ' + 1')} AS next_month, {_fmt_idx(_MIDX + ' - 1')} AS prev_month,
       {_fmt_idx(_MIDX + ' + 13')} AS plus_13, {_fmt_idx(_MIDX + ' - 13')} AS minus_13,
       CAST(abs({_MIDX} - 24000) AS INTEGER) AS distance_to_2000
FROM (SELECT ym, left(regexp_replace(ym, '[^0-9]', '', 'g'), 6) AS r FROM v_months)"""))
def month_normalize(spark, sf):
    """X1 + X2: month normalisation, index, shifts and distance."""
    m = bind(spark, sf).months.select("ym")
    r = X.normalize_month("ym")
    return m.select("ym", r.alias("yyyymm"), X.dash_month(r).alias("dashed"), X.month_index("ym").alias("month_index"),
                    X.shift_month("ym", 1).alias("next_month"), X.shift_month("ym", -1).alias("prev_month"),
                    X.shift_month("ym", 13).alias("plus_13"), X.shift_month("ym", -13).alias("minus_13"),
                    X.month_distance("ym", F.lit("200001")).cast("int").alias("distance_to_2000"))


@register("zip_normalize", with_views("""
SELECT k, raw_zip, lpad(NULLIF(left(raw_zip, 5), ''), 5, '0') AS zip5,
       left(NULLIF(trim(lpad(NULLIF(left(raw_zip, 5), ''), 5, '0')), ''), 3) AS zip3,
       raw_fips,
       lpad(NULLIF(trim(raw_fips), ''), CAST(greatest(length(NULLIF(trim(raw_fips), '')), 5) AS INTEGER), '0') AS fips5
FROM (SELECT k, CAST(a * 613 AS VARCHAR) AS raw_zip,
             ' ' || regexp_replace(county_fips, '^0+', '') || ' ' AS raw_fips FROM v_provider)"""))
def zip_normalize(spark, sf):
    """X3 + X4 + X5: ZIP5 / ZIP3 normalisation and FIPS padding of raw ids."""
    p = bind(spark, sf).provider
    raw_zip = (F.col("a") * 613).cast("string")
    raw_fips = F.concat(F.lit(" "), F.regexp_replace("county_fips", "^0+", ""), F.lit(" "))
    z = X.normalize_zip5(raw_zip)
    return p.select("k", raw_zip.alias("raw_zip"), z.alias("zip5"), X.prefix(z, 3, trim=True).alias("zip3"),
                    raw_fips.alias("raw_fips"), X.pad_id(raw_fips, 5).alias("fips5"))


@register("text_normalize", with_views("""
SELECT doc_id, t AS normalized, md5(t) AS text_key
FROM (SELECT doc_id, trim(regexp_replace(replace(upper(coalesce(text, '')), 'ẞ', 'SS'), '\\s+', ' ', 'g')) AS t
      FROM documents)"""))
def text_normalize(spark, sf):
    """X7 (+X8 key): whole document texts normalised."""
    d = bind(spark, sf).table("documents")
    t = X.normalize_text("text")
    return d.select("doc_id", t.alias("normalized"), F.md5(t).alias("text_key"))


@register("address_key", with_views(f"""
SELECT DISTINCT {address_id_sql()} AS address_id, {address_full_sql()} AS address_full FROM v_merged"""))
def address_key(spark, sf):
    """X8 + X9: address id and one-line address of every merged row."""
    m = bind(spark, sf).merged
    return m.select(X.address_id(AD.ADDRESS_PARTS).alias("address_id"),
                    X.address_full(*AD.ADDRESS_PARTS).alias("address_full")).distinct()


@register("code_category", with_views("""
SELECT c.code, c.n AS code_number, coalesce(r.label, 'Uncategorized') AS category, l.layer
FROM (SELECT DISTINCT code, CASE WHEN regexp_full_match(code, 'D[0-9]{4}') THEN CAST(substr(code, 2, 4) AS INTEGER) END
      AS n FROM v_claims) c
LEFT JOIN cat_ranges r ON c.n BETWEEN r.lo AND r.hi
LEFT JOIN layer_map l ON l.category = r.label"""))
def code_category(spark, sf):
    """X10 + X11 + J14: code number, category and layer of every code."""
    c = bind(spark, sf).claims.select("code").distinct()
    cat = c.select("code", X.code_number("code").alias("code_number"), X.code_category("code").alias("category"))
    return cat.select("code", "code_number", "category", X.layer_key("category").alias("layer"))


@register("id_class", with_views("""
SELECT servicing_id, CASE
    WHEN servicing_id IS NULL OR servicing_id IN ('', 'nan', '<NA>') THEN 'NULL'
    WHEN t = '0000000000' THEN 'sentinel: all zeros'
    WHEN regexp_full_match(t, '[19]+') AND contains(t, '9') THEN 'sentinel: nines pattern'
    WHEN regexp_full_match(t, '[A-Z][A-Z0-9]{9}') THEN
      CASE left(t, 1) WHEN 'A' THEN 'state-assigned: A-prefix (Atypical)'
                      WHEN 'M' THEN 'state-assigned: M-prefix (Medicaid)'
                      ELSE 'state-assigned: ' || left(t, 1) || '-prefix' END
    WHEN regexp_full_match(t, '[0-9]{10}') THEN 'NPI-format'
    ELSE 'other malformed' END AS bucket
FROM (SELECT DISTINCT servicing_id, upper(trim(servicing_id)) AS t FROM v_claims)"""))
def id_class(spark, sf):
    """Identifier class of every distinct servicing id."""
    c = bind(spark, sf).claims.select("servicing_id").distinct()
    return c.select("servicing_id", X.classify_id("servicing_id").alias("bucket"))
