"""Quantile colour stops and colour classes.

Stops are computed for every slice at once. The window that ranks values is
partitioned by the slice (a slice holds one value per region of a level,
i.e. at most a few thousand rows), and only the seven picked ranks of each
slice survive to the final group-by, so no slice is ever collected whole.

The index rule is not ``percentile_disc``: stop i is the value at 0-based
position ``min(n-1, floor(q_i * n))`` of the ascending positives, with q as
IEEE doubles; then ties are nudged up so the stops strictly ascend.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K


def quantile_positions(metric: str) -> list[float]:
    return list(K.QUANTILES_BASE) + [K.TOP_CLIP[metric]]


def quantile_stops(values: DataFrame, scope: list[str], value: str = "value",
                   metric: str = "claims", universe: DataFrame | None = None) -> DataFrame:
    """Seven strictly ascending stops per ``scope`` slice as columns
    ``s0..s6``. Only positive, non-NULL values count (F7); a slice with
    none gets the default stops 0..6. ``universe`` lists the slices to
    report (default: every slice present in ``values``)."""
    qs = quantile_positions(metric)
    gap = K.MIN_GAP[metric]
    v = F.col(value).cast("double")
    pos = v.isNotNull() & (v > 0)
    # One window over every row of a slice: positives sort first, so their
    # row number is their rank among positives; n counts positives only.
    # Non-positive rows keep the slice present (default stops) without a
    # second pass over the input.
    w = Window.partitionBy(*scope)
    ranked = values.select(*scope, v.alias("v"), pos.alias("pos")).select(
        *scope, "v", "pos",
        F.row_number().over(w.orderBy(F.desc("pos"), F.asc("v"))).alias("rn"),
        F.count_if("pos").over(w).alias("n"))
    targets = F.array(*[(F.least(F.col("n") - 1, F.floor(F.lit(q) * F.col("n"))) + 1).cast("long") for q in qs])
    picked = ranked.filter((F.col("rn") == 1) | (F.col("pos") & F.array_contains(targets, F.col("rn").cast("long"))))
    per = picked.groupBy(*scope).agg(
        F.map_from_entries(F.collect_list(F.when(F.col("pos"), F.struct(F.col("rn").cast("long"), "v")))).alias("m"),
        F.max("n").alias("n"))
    tcols = [F.least(F.col("n") - 1, F.floor(F.lit(q) * F.col("n"))).cast("long") + 1 for q in qs]
    raw = F.array(*[F.element_at(F.col("m"), t) for t in tcols])
    folded = F.aggregate(
        F.slice(raw, 2, K.N_STOPS - 1), F.array(F.element_at(raw, 1)),
        lambda acc, x: F.concat(acc, F.array(
            F.when(x > F.element_at(acc, -1), x).otherwise(F.element_at(acc, -1) + F.lit(gap)))))
    default = F.array(*[F.lit(float(x)) for x in K.DEFAULT_STOPS])
    stops = per.select(*scope, F.when(F.col("n") > 0, folded).otherwise(default).alias("stops"))
    if universe is not None:
        stops = universe.select(*scope).join(stops, scope, "left").withColumn(
            "stops", F.coalesce(F.col("stops"), default))
    return stops.select(*scope, *[F.col("stops")[i].alias(f"s{i}") for i in range(K.N_STOPS)])


def color_class(values: DataFrame, stops: DataFrame, scope: list[str], value: str = "value") -> DataFrame:
    """Palette band 0..6 and interpolation fraction ``t`` of each value
    against its slice's stops. Below the first stop -> band 0, at or above
    the last -> band 6; NULL values -> ``no_data`` (band NULL)."""
    j = values.join(stops, scope, "left")
    v = F.col(value).cast("double")
    s = [F.col(f"s{i}") for i in range(K.N_STOPS)]
    band = F.when(v.isNull(), F.lit(None).cast("int")).when(v <= s[0], F.lit(0)) \
        .when(v >= s[K.N_STOPS - 1], F.lit(K.N_STOPS - 1))
    t = F.when(v.isNull() | (v <= s[0]) | (v >= s[K.N_STOPS - 1]), F.lit(0.0))
    for i in range(K.N_STOPS - 1):
        inside = (v >= s[i]) & (v <= s[i + 1])
        band = band.when(inside, F.lit(i))
        span = s[i + 1] - s[i]
        t = t.when(inside, F.when(span > 0, (v - s[i]) / span).otherwise(F.lit(0.0)))
    band = band.otherwise(F.lit(K.N_STOPS - 1))
    return j.select(*[c for c in values.columns], band.alias("band"),
                    F.round(t, 6).alias("t"), v.isNull().alias("no_data"))
