"""Tidy exports, selections and estimates.

An export covers any number of regions, periods and categories in one
grouping-sets aggregate over the pre-aggregated table. Selections are
DataFrames joined with ``left_semi``, so a selection of 100k regions is a
join, not a literal IN list; short lists may be given as Python lists.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import scalars as X
from .denominators import attach_denominator
from .rates import layer_values

VIEW_COLUMNS = ["region_id", "region_name", "level", "year", "category",
                "total_claims", "total_beneficiaries_served", "total_amount_paid"]
SUBSET_COLUMNS = ["region_id", "region_name", "level", "period", "category",
                  "total_claims", "total_beneficiaries_served", "total_amount_paid",
                  "medicaid_enrollees", "claims_per_enrollee"]


def region_name(level: str, key: str = "key", names: DataFrame | None = None) -> "F.Column":
    """Display name with fallback to the id: state -> state name,
    county -> label from ``names`` (joined by the caller as ``__name``),
    ZIP3 -> ``ZIP3 nnn``."""
    k = F.col(key)
    if level == "state":
        return F.coalesce(X.state_name(k), k)
    if level == "county":
        return F.coalesce(F.col("__name"), k) if names is not None else k
    return F.concat(F.lit("ZIP3 "), k)


def attach_names(df: DataFrame, level: str, dim: DataFrame | None = None, key: str = "region_id") -> DataFrame:
    """``region_name`` from a name dimension (``region_id``, ``name``) with
    the level's fallback (state name, the id, or ``ZIP3 nnn``)."""
    if dim is not None:
        d = dim.select(F.col("region_id").alias("__rid"), F.col("name").alias("__name"))
        df = df.join(d, F.col(key) == F.col("__rid"), "left").drop("__rid")
    else:
        df = df.withColumn("__name", F.lit(None).cast("string"))
    fallback = region_name(level, key)
    return df.withColumn("region_name", F.coalesce(F.col("__name"), fallback)).drop("__name")


def drop_zero_rows(df: DataFrame, measures=("total_claims", "total_beneficiaries_served",
                                            "total_amount_paid")) -> DataFrame:
    """drop rows whose measures are all zero (after aggregation)."""
    cond = None
    for m in measures:
        c = F.col(m) == 0
        cond = c if cond is None else (cond & c)
    return df.filter(~cond)


def _select(df: DataFrame, col: str, values) -> DataFrame:
    """keep rows whose ``col`` is in ``values`` (list or one-column DataFrame)."""
    if values is None:
        return df
    if isinstance(values, DataFrame):
        sel = values.select(F.col(values.columns[0]).alias("__sel")).distinct()
        return df.join(sel, F.col(col) == F.col("__sel"), "left_semi")
    return df.filter(F.col(col).isin(list(values)))


def view_export(agg: DataFrame, level: str, period: str | None = None, layer: str = "all") -> DataFrame:
    """A22 + F3 + F6 + K5: one row per region for the current view (``layer``
    and ``period``; every period when ``period`` is None), zero rows dropped,
    ordered by region (then period)."""
    v = layer_values(agg).filter(F.col("layer") == layer)
    if period is not None:
        v = v.filter(F.col("period") == period)
    v = drop_zero_rows(v)
    return v.select(
        F.col("key").alias("region_id"),
        region_name(level).alias("region_name"),
        F.lit(level).alias("level"),
        F.col("period").alias("year"),
        F.lit(K.LAYER_LABELS[layer]).alias("category"),
        "total_claims", "total_beneficiaries_served", "total_amount_paid",
    ).orderBy("region_id", "year")


def subset_export(agg: DataFrame, level: str, denom: DataFrame | None = None,
                  periods=None, categories=None, regions=None, include_all: bool = False,
                  county_names: DataFrame | None = None) -> DataFrame:
    """A23 + F9 + K6 + O2: tidy rows region x period x chosen layer, plus an
    optional "All Categories" row that sums every category of the
    region/period (chosen or not, layered or not). ``None`` for periods,
    categories or regions means all of them, an empty list none. Zero rows drop; the
    denominator and rate are NULL without an enrollment record."""
    base = _select(_select(agg, "key", regions), "period", periods)
    v = layer_values(base)
    wanted = v.filter(F.col("layer") != "all")
    parts = _select(wanted, "layer", categories)
    if include_all:
        parts = parts.unionByName(v.filter(F.col("layer") == "all"))
    parts = drop_zero_rows(parts)
    if denom is not None:
        parts = attach_denominator(parts, denom)
    else:
        parts = parts.withColumn("medicaid_enrollees", F.lit(None).cast("bigint"))
    if county_names is not None and level == "county":
        parts = parts.join(county_names.select(F.col("region_id").alias("key"), F.col("name").alias("__name")),
                           "key", "left")
    out = parts.select(
        F.col("key").alias("region_id"),
        region_name(level, names=county_names if level == "county" else None).alias("region_name"),
        F.lit(level).alias("level"),
        "period",
        X.layer_label("layer").alias("category"),
        "total_claims", "total_beneficiaries_served", "total_amount_paid",
        "medicaid_enrollees",
        X.safe_rate("total_claims", "medicaid_enrollees", 6).alias("claims_per_enrollee"),
    )
    return out.orderBy("region_id", "period", "category")


def available_periods(agg: DataFrame) -> DataFrame:
    """The distinct periods, ascending."""
    return agg.select("period").distinct().orderBy("period")


def estimate_rows(regions: DataFrame, periods: DataFrame, n_categories: int,
                  include_all: bool, cap: int = K.SUBSET_ROW_CAP) -> DataFrame:
    """Regions x periods x (categories + all) before zero rows drop, and
    whether it exceeds the confirmation cap. One row; no driver collect."""
    r = regions.select(F.count_distinct(F.col(regions.columns[0])).alias("n_regions"))
    p = periods.select(F.count_distinct(F.col(periods.columns[0])).alias("n_periods"))
    n_r = r.scalar()
    n_p = p.scalar()
    spark = regions.sparkSession
    est = (n_r * n_p * F.lit(n_categories + (1 if include_all else 0))).cast("bigint")
    return spark.range(1).select(est.alias("estimated_rows"),
                                 (est > F.lit(cap)).alias("over_cap"))


def estimate_value(region_count: int, period_count: int, category_count: int, include_all: bool) -> int:
    """A25 as plain arithmetic (for UI-sized inputs)."""
    return region_count * period_count * (category_count + (1 if include_all else 0))


def region_dimension(spark: SparkSession, agg: DataFrame, level: str) -> DataFrame:
    """The region universe of a level with its display names."""
    keys = agg.select("key").distinct()
    return keys.select(F.col("key").alias("region_id"), region_name(level).alias("region_name"))


def search_regions(dim: DataFrame, text: str, limit: int = K.SEARCH_LIMIT) -> DataFrame:
    """F8 + O4: regions whose id or name contains the trimmed, lower-cased
    text (literal substring; blank matches all), first ``limit`` by id, and
    the total number of matches on every row."""
    q = text.strip().lower()
    m = dim
    if q:
        m = dim.filter(F.lower("region_id").contains(F.lit(q)) | F.lower("region_name").contains(F.lit(q)))
    n = m.select(F.count(F.lit(1))).scalar()
    return m.orderBy("region_id").limit(limit).select("region_id", "region_name", n.alias("n_matches"))
