"""Incremental month processing (I2, I3, K1): streaming result equals batch."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, LongType, StringType, StructField, StructType

from ..functions import scalars as X
from ..session import checkpoint_dir
from ..sources.sinks import write_by_month
from ..streaming.incremental import build_months, finished_months, run_incremental
from .catalog import bind, register
from .oracle_views import with_views

INPUT_SCHEMA = StructType([
    StructField("servicing_id", StringType()), StructField("code", StringType()),
    StructField("benef", LongType()), StructField("claims", LongType()),
    StructField("paid", DecimalType(18, 2)), StructField("ym", StringType()),
])
OUTPUT_SCHEMA = StructType([
    StructField("category", StringType()), StructField("total_beneficiaries_served", LongType()),
    StructField("total_claims", LongType()), StructField("total_amount_paid", DecimalType(38, 2)),
    StructField("ym", StringType()),
])


def monthly_category(full: DataFrame) -> DataFrame:
    """Per (month, category) sums of the claim rows of the given months."""
    return full.groupBy("ym", X.code_category("code").alias("category")).agg(
        F.sum("benef").cast("bigint").alias("total_beneficiaries_served"),
        F.sum("claims").cast("bigint").alias("total_claims"),
        F.sum("paid").cast("decimal(38,2)").alias("total_amount_paid"))


_MONTHLY_SELECT = """
SELECT d.year_month AS ym, coalesce(r.label, 'Uncategorized') AS category,
       CAST(sum(benef) AS BIGINT) AS total_beneficiaries_served, CAST(sum(claims) AS BIGINT) AS total_claims,
       CAST(sum(paid) AS DECIMAL(38,2)) AS total_amount_paid
FROM v_dental d LEFT JOIN cat_ranges r
  ON CASE WHEN regexp_full_match(d.code, 'D[0-9]{4}') THEN CAST(substr(d.code, 2, 4) AS INTEGER) END
     BETWEEN r.lo AND r.hi
GROUP BY ALL"""
_MONTHLY = with_views(_MONTHLY_SELECT)


@register("incremental_months", _MONTHLY)
def incremental_months(spark, sf):
    """I2 + K1: dental rows land month-partitioned in two arrivals (the second
    holds the later months plus a late file for an already-processed month);
    two availableNow runs from one checkpoint give the batch result."""
    b = bind(spark, sf)
    root = os.path.join(checkpoint_dir(spark), f"incremental-{uuid.uuid4().hex}")
    src, dst, ck = (os.path.join(root, p) for p in ("src", "dst", "checkpoint"))
    rows = b.dental.select("servicing_id", "code", "benef", "claims", "paid", F.col("year_month").alias("ym"))
    mi = X.month_index("ym")
    rng = b.months.agg(F.min("mi").alias("lo"), F.max("mi").alias("hi"))
    cut = F.floor((rng.select("lo").scalar() + rng.select("hi").scalar()) / 2)
    late = (mi == cut - 1) & (F.col("benef") % 2 == 0)
    first = (mi < cut) & ~late

    write_by_month(rows.filter(first), src, mode="append")
    run_incremental(spark, src, dst, ck, INPUT_SCHEMA, monthly_category)
    write_by_month(rows.filter(~first), src, mode="append")
    run_incremental(spark, src, dst, ck, INPUT_SCHEMA, monthly_category)
    return spark.read.schema(OUTPUT_SCHEMA).parquet(dst).select(
        "ym", "category", "total_beneficiaries_served", "total_claims", "total_amount_paid")


@register("forced_rebuild", with_views("""
SELECT m.*, 'forced' AS made_by FROM (""" + _MONTHLY_SELECT + """) m"""))
def forced_rebuild(spark, sf):
    """A stream run lists its months in the manifest; then the output of
    every month is spoilt, and a forced build makes and lists all anew."""
    root = os.path.join(checkpoint_dir(spark), f"rebuild-{uuid.uuid4().hex}")
    src, dst, ck, manifest = (os.path.join(root, p) for p in ("src", "dst", "checkpoint", "manifest"))
    rows = bind(spark, sf).dental.select("servicing_id", "code", "benef", "claims", "paid", F.col("year_month").alias("ym"))
    write_by_month(rows, src, mode="append")
    run_incremental(spark, src, dst, ck, INPUT_SCHEMA, monthly_category, manifest=manifest)
    write_by_month(monthly_category(rows).withColumn("total_claims", F.lit(-1).cast("long")), dst)
    build_months(spark, src, dst, manifest, INPUT_SCHEMA, monthly_category, force=True)
    out = spark.read.schema(OUTPUT_SCHEMA).parquet(dst).select(
        "ym", "category", "total_beneficiaries_served", "total_claims", "total_amount_paid")
    return out.join(finished_months(spark, manifest).select("ym", "made_by"), "ym")
