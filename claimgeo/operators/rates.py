"""Region values, rates, detail statistics and category ranking.

All slices are computed at once: one grouping-sets aggregate gives every
(region, period, layer) value including the "all" layer, instead of one job
per slice. Per-region windows (W4) partition by (region, period), a few
dozen rows each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as X
from .aggregate import MEASURES
from .denominators import attach_denominator


def layer_values(agg: DataFrame, extra: list[str] = ()) -> DataFrame:
    """Per (``extra``..., key, period, layer): the three sums; ``layer`` is a
    layer key or ``all`` (which also counts categories without a layer)."""
    g = agg.withColumn("layer", X.layer_key("category"))
    sums = [F.sum(m).alias(m) for m in MEASURES]
    keys = [*extra, "key", "period"]
    out = g.groupingSets([[*keys, "layer"], keys], *keys, "layer") \
        .agg(F.grouping("layer").alias("__g"), *sums)
    out = out.filter((F.col("__g") == 1) | F.col("layer").isNotNull())
    return out.select(*extra, "key", "period",
                      F.when(F.col("__g") == 1, F.lit("all")).otherwise(F.col("layer")).alias("layer"),
                      F.col("total_beneficiaries_served").cast("bigint").alias("total_beneficiaries_served"),
                      F.col("total_claims").cast("bigint").alias("total_claims"),
                      F.col("total_amount_paid").cast("decimal(38,2)").alias("total_amount_paid"))


def level_layer_values(base: DataFrame, levels: dict[str, str], period: str = "year") -> DataFrame:
    """Per (level, key, period, layer) sums from claim rows: they are first
    aggregated to a fine table over all level keys, period and category, and
    only its rows are exploded into their (level, layer) and (level, 'all')
    keys, for one group-by of every region value of every level and layer.
    Rows without a layer (Uncategorized) count only in 'all'."""
    keys = list(dict.fromkeys([*levels.values(), period, "category"]))
    base = base.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in ("benef", "claims", "paid")])
    lay = X.layer_key("category")
    specs = []
    for level, k in levels.items():
        specs.append(F.struct(F.lit(level).alias("level"), F.col(k).alias("key"), lay.alias("layer")))
        specs.append(F.struct(F.lit(level).alias("level"), F.col(k).alias("key"), F.lit("all").alias("layer")))
    ex = base.select(F.inline(F.array(*specs)), F.col(period).alias("period"), "benef", "claims", "paid")
    return (ex.filter(F.col("key").isNotNull() & F.col("layer").isNotNull())
              .groupBy("level", "key", "period", "layer")
              .agg(F.sum("benef").cast("bigint").alias("total_beneficiaries_served"),
                   F.sum("claims").cast("bigint").alias("total_claims"),
                   F.sum("paid").cast("decimal(38,2)").alias("total_amount_paid")))


def values_of(v: DataFrame, metric: str = "claims", denom: DataFrame | None = None,
              extra: list[str] = ()) -> DataFrame:
    """The map value of each layered row: claims, or claims per enrollee
    (NULL without a positive denominator), not rounded."""
    out = v.select(*extra, "key", "period", "layer", "total_claims")
    if metric == "claims":
        return out.withColumn("value", F.col("total_claims").cast("double"))
    if denom is None:
        raise ValueError("metric 'enrollees' needs a denominator")
    out = attach_denominator(out, denom, extra=extra)
    enrollees = F.col("medicaid_enrollees")
    return out.withColumn("value", F.when(enrollees > 0, F.col("total_claims").cast("double") / enrollees.cast("double")))


def region_value(agg: DataFrame, period: str | None = None, layer: str | None = None,
                 metric: str = "claims", denom: DataFrame | None = None,
                 universe: DataFrame | None = None, extra: list[str] = ()) -> DataFrame:
    """Value per region for (period, layer, metric).

    With ``period`` and ``layer`` given, every region of ``universe``
    (default: every key of ``agg``) is kept and a region without records is
    0; with them omitted, every present slice is returned. ``metric`` is
    ``claims`` or ``enrollees`` (claims per enrollee, NULL without a
    positive denominator)."""
    v = layer_values(agg, extra)
    if period is not None:
        v = v.filter(F.col("period") == period)
    if layer is not None:
        v = v.filter(F.col("layer") == layer)
    if period is not None and layer is not None:
        u = (universe if universe is not None else agg.select("key").distinct())
        u = u.select("key").withColumn("period", F.lit(period)).withColumn("layer", F.lit(layer))
        v = u.join(v, ["key", "period", "layer"], "left").fillna(0, subset=["total_claims"])
    return values_of(v, metric, denom, extra)


def region_detail(agg: DataFrame, denom: DataFrame | None) -> DataFrame:
    """Per (region, period): claims, paid, enrollees, paid per claim and
    claims per enrollee, each ratio NULL when its denominator is not positive."""
    t = agg.groupBy("key", "period").agg(
        F.sum("total_claims").cast("bigint").alias("total_claims"),
        F.sum("total_amount_paid").cast("decimal(38,2)").alias("total_amount_paid"))
    if denom is not None:
        t = attach_denominator(t, denom)
    else:
        t = t.withColumn("medicaid_enrollees", F.lit(None).cast("bigint"))
    return t.select(
        "key", "period", "total_claims", "total_amount_paid", "medicaid_enrollees",
        F.round(X.avg_paid("total_amount_paid", "total_claims"), 6).alias("paid_per_claim"),
        X.safe_rate("total_claims", "medicaid_enrollees", 6).alias("claims_per_enrollee"))


def category_ranking(agg: DataFrame) -> DataFrame:
    """Categories of each (region, period) by claims desc (ties by label),
    with the bar share ``100 * claims / max(max claims, 1)``."""
    w = Window.partitionBy("key", "period")
    return agg.select(
        "key", "period", "category", "total_claims",
        F.row_number().over(w.orderBy(F.desc("total_claims"), F.asc("category"))).alias("rank"),
        F.round(F.lit(100.0) * F.col("total_claims")
                / F.greatest(F.max("total_claims").over(w), F.lit(1)), 6).alias("bar_pct"))
