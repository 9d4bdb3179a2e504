"""Sources (S1, S2, S4, S5, S7, S9, S11, S12, S13).

CSV columns are bound by header name and read as text (leading zeros matter);
counts and money are then cast, and what does not parse raises. No inference
pass runs over the data and CSV splits are read in parallel.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import scalars as X
from ..operators.aggregate import duplicate_keys, parse_ndjson_lines
from ..operators.denominators import read_enrollment, read_or_empty  # noqa: F401  (re-export S9, S13)
from .csv import quoted, read_csv, read_csv_groups, require_columns, typed



def read_claims(spark: SparkSession, path: str, rename: dict[str, str] = K.CLAIMS_COLUMNS, bad: str = "raise") -> DataFrame:
    """Claims CSV, columns bound by header name and renamed, counts as
    BIGINT and money as DECIMAL(18,2), plus ``ym`` (X1). A number that does
    not parse raises unless ``bad="null"``."""
    kinds = {"benef": "bigint", "claims": "bigint", "paid": "decimal(18,2)"}
    df = read_csv(spark, path, list(rename))
    out = df.select(*[(typed(src, kinds[dst], bad) if dst in kinds else quoted(src)).alias(dst) for src, dst in rename.items()])
    return out.withColumn("ym", X.normalize_month("year_month"))


def read_snapshots(spark: SparkSession, path_glob: str, name_regex: str = K.SNAPSHOT_NAME_RE, in_path: bool = False) -> DataFrame:
    """Registry snapshots with the month taken from each file's name, or,
    with ``in_path``, from its whole path (month folders).

    Every column is read as text and by the header of its own file; columns
    that a file lacks are NULL. Files whose name does not match give an empty
    ``ym``; :func:`snapshot_rejects` lists them and the caller drops them.
    """
    out, where = None, "_metadata.file_path" if in_path else "_metadata.file_name"
    for df in read_csv_groups(spark, path_glob):
        df = df.withColumn("ym", F.regexp_extract(F.col(where), name_regex, 1)) \
               .withColumn("_file", F.col("_metadata.file_name"))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise FileNotFoundError(path_glob)
    return out


def snapshot_rejects(snaps: DataFrame) -> DataFrame:
    """Names of files that carry no month in their name."""
    return snaps.filter(F.col("ym") == "").select("_file").distinct()


def columns_by_prefix(df: DataFrame, prefix: str) -> list[str]:
    """Columns starting with ``prefix``, ordered by their numeric suffix."""
    def suffix(c: str) -> int:
        m = re.search(r"(\d+)\s*$", c)
        return int(m.group(1)) if m else 0
    return sorted([c for c in df.columns if c.startswith(prefix)], key=suffix)


def taxonomy_pairs(df: DataFrame, code_prefix: str, switch_prefix: str) -> Column:
    """The (code, primary switch) slot columns as ``ARRAY<STRUCT<code, switch>>``."""
    codes = columns_by_prefix(df, code_prefix)
    switches = columns_by_prefix(df, switch_prefix)
    return F.array(*[F.struct(F.col(c).alias("code"), F.col(s).alias("switch")) for c, s in zip(codes, switches)])


def read_keyed_ndjson(spark: SparkSession, path: str, period_field: str = "year", check_duplicates: bool = True,
                      fields: dict[str, str] | None = None) -> DataFrame:
    """Keyed NDJSON (``{"<key>": [records]}`` per line) -> rows. A key
    on two lines raises (D9) instead of silently keeping one, and so does a
    line that is not such a record. ``fields`` gives the record's fields and
    types (default: the claims record)."""
    lines = spark.read.text(path)
    if check_duplicates:
        dups = duplicate_keys(lines)
        n = dups.count()
        if n:
            raise ValueError(f"{n} duplicate NDJSON keys, such as {[r.key for r in dups.orderBy('key').limit(20).collect()]}")
    return parse_ndjson_lines(lines, period_field, fields=fields)


def read_region_names(spark: SparkSession, geojson_path: str, id_props=("GEOID", "id"),
                      name_prop: str = "name", lsad_prop: str | None = None) -> DataFrame:
    """GeoJSON features -> (region_id, name) dimension. With
    ``lsad_prop`` the name is the county label of X20."""
    fc = spark.read.option("multiLine", "true").json(geojson_path)
    feats = fc.select(F.explode("features").alias("f"))
    has_id = "id" in feats.schema["f"].dataType.names
    props = feats.select("f.properties.*", *[F.col("f.id").alias("__fid")] * has_id)
    ids = [F.col(p) for p in id_props if p in props.columns] + [F.col("__fid")] * has_id
    region = F.coalesce(*ids).cast("string")
    lsad = F.col(lsad_prop) if lsad_prop in props.columns else F.lit(None).cast("string")
    name = X.county_label(region, name_prop, lsad) if lsad_prop else F.col(name_prop)
    return props.select(region.alias("region_id"), name.alias("name"))


def snapshot_table(raw: DataFrame) -> DataFrame:
    """T3 from a raw snapshot read (:func:`read_snapshots`): the five practice
    address columns (required), the country column found by prefix, and the
    primary taxonomy code chosen over the (code, switch) slots in numeric
    order (X14); the postal code becomes a ZIP5 (X3). Files without a month
    in their name are dropped (list them with :func:`snapshot_rejects`)."""
    require_columns(raw, ["NPI", *K.SNAPSHOT_ADDRESS_COLUMNS])
    country = columns_by_prefix(raw, K.SNAPSHOT_COUNTRY_PREFIX)
    if not country:
        raise KeyError("missing practice-location country code column")
    codes = columns_by_prefix(raw, K.SNAPSHOT_TAXONOMY_CODE_PREFIX)
    switches = columns_by_prefix(raw, K.SNAPSHOT_TAXONOMY_SWITCH_PREFIX)
    q = quoted
    a = K.SNAPSHOT_ADDRESS_COLUMNS
    return raw.filter(F.col("ym") != "").select(
        q("NPI").alias("npi"), "ym",
        q(a[0]).alias("practice_address_line_1"), q(a[1]).alias("practice_address_line_2"),
        q(a[2]).alias("practice_city"), q(a[3]).alias("practice_state"),
        X.normalize_zip5(q(a[4])).alias("practice_zip5"),
        q(country[0]).alias("practice_country_code"),
        X.primary_value([(q(c), q(w)) for c, w in zip(codes, switches)]).alias("primary_taxonomy_code"),
    )


def merge_claims(claims: DataFrame, snapshots: DataFrame) -> DataFrame:
    """T4: dental claim rows (``read_claims`` + code filter) joined to the
    same-month snapshot row of their servicing id (J1), in the 14 merged
    columns. ``ym`` on both sides is ``YYYYMM``; NULL ids never match."""
    j = claims.join(snapshots, (claims["servicing_id"] == snapshots["npi"]) & (claims["ym"] == snapshots["ym"]))
    return j.select(
        F.col("servicing_id").alias("servicing_npi"), F.col("billing_id").alias("billing_npi"),
        F.col("code").alias("hcpcs_code"), F.col("year_month"),
        F.col("benef").alias("beneficiaries_served_count"), F.col("claims").alias("claims_count"),
        F.col("paid").alias("total_amount_paid"),
        "practice_address_line_1", "practice_address_line_2", "practice_city", "practice_state",
        "practice_zip5", "practice_country_code", "primary_taxonomy_code")


def read_merged(spark: SparkSession, path: str, extra: tuple[str, ...] = (), bad: str = "raise") -> DataFrame:
    """Merged-claims CSV by header name (ids and ZIPs stay text, counts
    BIGINT, money DECIMAL(18,2)). ``extra`` names further text columns, such
    as ``county_fips`` of the geocoded claims that the aggregates start from."""
    kinds = {"beneficiaries_served_count": "bigint", "claims_count": "bigint", "total_amount_paid": "decimal(18,2)"}
    df = read_csv(spark, path, [*K.MERGED_COLUMNS, *extra])
    return df.select(*[(typed(c, kinds[c], bad) if c in kinds else quoted(c)).alias(c) for c in [*K.MERGED_COLUMNS, *extra]])


def read_geo_claims(spark: SparkSession, path: str, bad: str = "raise") -> DataFrame:
    """The geocoded claims CSV under the names that the aggregates expect."""
    df = read_merged(spark, path, ("county_fips",), bad)
    return df.select(F.col("servicing_npi").alias("servicing_id"), F.col("hcpcs_code").alias("code"), "year_month",
                     F.col("beneficiaries_served_count").alias("benef"), F.col("claims_count").alias("claims"),
                     F.col("total_amount_paid").alias("paid"), "practice_zip5",
                     X.pad_id("county_fips", 5).alias("county_fips"))
