"""Reports built from the id-set operators.

Reports are small (one row per month, bucket or stage); shares of a total
use a window over the whole report, which is a handful of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import scalars as X
from .snapshot import month_distance


def _pct(num, den) -> F.Column:
    return F.round(F.when(den > 0, F.lit(100.0) * num / den).otherwise(F.lit(0.0)), 6)


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Frequency of each value, NULL kept as a group."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def coverage_report(marked: DataFrame, window: int = 1) -> DataFrame:
    """Per month: claim rows, merged rows, dropped = claims − merged
    (the reference's count, D2) and the true drops, drop %, dropped ids,
    rows/ids recoverable within the window, recovery % of drops. One aggregate
    over the marked (month, id) groups (:func:`snapshot.mark_presence`)."""
    gone = ~F.col("in_same_month")
    back = gone & F.coalesce(month_distance() <= window, F.lit(False))

    def rows(when, value=F.col("n_rows")):
        return F.coalesce(F.sum(F.when(when, value)), F.lit(0)).cast("bigint")

    j = marked.groupBy("year_month").agg(
        F.sum("n_rows").cast("bigint").alias("hhs_dental_rows"),
        rows(F.col("in_same_month"), F.col("n_rows") * F.col("same_rows")).alias("merged_rows"),
        F.count_if(gone).alias("dropped_npis"), rows(gone).alias("anti_rows"),
        F.count_if(back).alias("recoverable_npis"), rows(back).alias("recoverable_rows"))
    dropped_rows = F.col("hhs_dental_rows") - F.col("merged_rows")
    return j.select(
        X.normalize_month("year_month").alias("year_month"),
        "hhs_dental_rows", "merged_rows", dropped_rows.alias("dropped_rows"),
        _pct(dropped_rows, F.col("hhs_dental_rows")).alias("drop_rate_pct"),
        "dropped_npis", "recoverable_rows", "recoverable_npis",
        _pct(F.col("recoverable_rows"), dropped_rows).alias("recovery_rate_of_drops_pct"),
        "anti_rows")


def coverage_total(report: DataFrame) -> DataFrame:
    """A10: overall totals and shares of the monthly report."""
    t = report.agg(*[F.sum(c).cast("bigint").alias(c) for c in
                     ("hhs_dental_rows", "merged_rows", "dropped_rows", "recoverable_rows")])
    res = F.col("dropped_rows") - F.col("recoverable_rows")
    return t.select(
        "hhs_dental_rows", "merged_rows", "dropped_rows", "recoverable_rows",
        res.alias("residual_rows"),
        _pct(F.col("merged_rows"), F.col("hhs_dental_rows")).alias("merged_pct"),
        _pct(F.col("dropped_rows"), F.col("hhs_dental_rows")).alias("dropped_pct"),
        _pct(F.col("recoverable_rows"), F.col("dropped_rows")).alias("recoverable_pct_of_drops"),
        _pct(F.col("recoverable_rows"), F.col("hhs_dental_rows")).alias("recoverable_pct_of_total"),
        _pct(res, F.col("hhs_dental_rows")).alias("residual_pct_of_total"))


def distance_buckets(dropped: DataFrame, edges=K.DISTANCE_EDGES) -> DataFrame:
    """Dropped (month, id) groups and rows by nearest-month distance:
    ``<=1``, ``<=3``, ``<=6``, ``<=12``, ``>12``, ``never``; rows with a NULL
    id (which can never match) are the ``null_id`` bucket. Shares are of all
    dropped rows."""
    distance = month_distance()
    b = F.when(F.col("servicing_id").isNull(), "null_id").when(distance.isNull(), "never")
    for e in edges:
        b = b.when(distance <= e, F.lit(f"<={e}"))
    g = dropped.groupBy(b.otherwise(F.lit(f">{edges[-1]}")).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n_id_months"), F.sum("n_rows").cast("bigint").alias("n_rows"))
    total = F.sum("n_rows").over(Window.partitionBy())
    return g.select("bucket", "n_id_months", "n_rows", _pct(F.col("n_rows"), total).alias("pct_of_dropped_rows"))


def drop_verdict(buckets: DataFrame) -> DataFrame:
    """A12: 'structural' if more than 80 % of dropped rows have ids never
    present, else 'comparison_bug' if more than 50 % are within one month,
    else 'mixed'."""
    t = buckets.agg(F.sum("n_rows").alias("total"),
                    F.sum(F.when(F.col("bucket") == "never", F.col("n_rows")).otherwise(0)).alias("never"),
                    F.sum(F.when(F.col("bucket") == "<=1", F.col("n_rows")).otherwise(0)).alias("near"))
    den = F.greatest(F.col("total"), F.lit(1))
    ns = F.col("never") / den
    nr = F.col("near") / den
    verdict = (F.when(ns > K.VERDICT_NEVER_SHARE, "structural")
               .when(nr > K.VERDICT_NEAR_SHARE, "comparison_bug").otherwise("mixed"))
    return t.select(F.round(ns, 6).alias("never_share"), F.round(nr, 6).alias("near_share"),
                    verdict.alias("verdict"))


def loss_waterfall(stages: list[tuple[str, DataFrame]]) -> DataFrame:
    """Rows remaining after each stage and rows lost at it. Each stage
    count is a Spark aggregate; the union is a handful of rows, and ``lag``
    runs over that one small partition."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(i).alias("stage_no"), F.lit(name).alias("stage"),
                                                             "rows")
             for i, (name, df) in enumerate(stages)]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    prev = F.lag("rows").over(Window.orderBy("stage_no"))
    return u.select("stage_no", "stage", "rows",
                    F.coalesce(prev - F.col("rows"), F.lit(0)).cast("bigint").alias("dropped"),
                    F.round(F.when(prev > 0, F.lit(100.0) * (prev - F.col("rows")) / prev)
                            .otherwise(F.lit(0.0)), 6).alias("dropped_pct"))


def loss_waterfall_once(claims: DataFrame, registry: DataFrame, kept: Column, located: Column,
                        fid: str = "servicing_id", fym: str = "year_month", sid: str = "npi", sym: str = "ym") -> DataFrame:
    """A13 in one pass over each side: claims reduced to (month, id) counts
    while they are read, the registry (each row with its address located or
    not) to the rows and located rows of an id in a month; one join of the two
    groups gives every stage. No raw row is shuffled, a sentinel id is one
    group a month, and registry rows that repeat an id multiply the joined rows as
    the row join does (D2). The counts are aggregates, so a re-run task does
    not count twice, as it would in accumulators."""
    groups = claims.groupBy(F.col(fid).alias("__id"), F.col(fym).alias("__ym")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(kept).alias("k")).filter("n > 0")
    seen = registry.filter(F.col(sid).isNotNull()).groupBy(F.col(sid).alias("__sid"), F.col(sym).alias("__sym")).agg(
        F.count(F.lit(1)).alias("same"), F.count_if(located).alias("there"))
    j = groups.join(seen, (F.col("__id") == F.col("__sid")) & (F.col("__ym") == F.col("__sym")), "left")
    total = [F.coalesce(F.sum(x), F.lit(0)).cast("bigint") for x in
             ("n", "k", F.col("k") * F.col("same"), F.col("k") * F.col("there"))]
    names = ("source", "code_filter", "snapshot_join", "geocoded")
    t = j.agg(*[x.alias(name) for x, name in zip(total, names)])
    stages = []
    for i, name in enumerate(names):
        rows, before = F.col(name), F.col(names[max(i - 1, 0)])
        stages.append(F.struct(F.lit(i).alias("stage_no"), F.lit(name).alias("stage"), rows.alias("rows"),
                               (before - rows).alias("dropped"),
                               F.round(F.when(before > 0, F.lit(100.0) * (before - rows) / before).otherwise(F.lit(0.0)), 6)
                               .alias("dropped_pct")))
    return t.select(F.inline(F.array(*stages)))


def share_of_total(df: DataFrame, measures: list[str], suffix: str = "_pct") -> DataFrame:
    """Each measure as a percentage of its column total, for a small
    report (the total is a window over the whole report)."""
    w = Window.partitionBy()
    return df.select("*", *[_pct(F.col(m).cast("double"), F.sum(m).over(w).cast("double")).alias(f"{m}{suffix}")
                            for m in measures])


def id_bucket_report(marked: DataFrame, claims: str = "claims", paid: str = "paid") -> DataFrame:
    """Q5 (X12 + X13 + A7 + A8): per identifier bucket: distinct ids (the
    NULL bucket has 0, D4), rows, claims and dollars (NULL -> 0), and the
    shares of each total."""
    b = X.refine_id(X.classify_id("servicing_id"), "in_same_month", "in_any_month")
    g = marked.select(b.alias("bucket"), "servicing_id", "n_rows", claims, paid).groupBy("bucket").agg(
        F.count_distinct("servicing_id").alias("unique_ids"),
        F.sum("n_rows").cast("bigint").alias("row_count"),
        F.sum(F.coalesce(F.col(claims), F.lit(0))).cast("bigint").alias("total_claims"),
        F.sum(F.coalesce(F.col(paid), F.lit(0))).cast("decimal(38,2)").alias("total_paid_usd"))
    w = Window.partitionBy()
    return g.select("*",
                    _pct(F.col("row_count"), F.sum("row_count").over(w)).alias("pct_of_rows"),
                    _pct(F.col("total_claims"), F.sum("total_claims").over(w)).alias("pct_of_claims"),
                    _pct(F.col("total_paid_usd").cast("double"),
                         F.sum("total_paid_usd").over(w).cast("double")).alias("pct_of_dollars"))


def suppress_small_cells(df: DataFrame, claims: str = "total_claims", benef: str = "total_beneficiaries_served",
                         measures=("total_claims", "total_beneficiaries_served", "total_amount_paid"),
                         k: int = K.SMALL_CELL_K) -> DataFrame:
    """Q7: cells with fewer than ``k`` claims or ``k`` beneficiaries are
    suppressed: measures become NULL and ``suppressed`` is true."""
    small = (F.col(claims) < k) | (F.col(benef) < k)
    cols = [F.when(~small, F.col(c)).alias(c) if c in measures else F.col(c) for c in df.columns]
    return df.select(*cols, small.alias("suppressed"))


def reliability_flags(df: DataFrame, value: str, moe: str, status: str | None = None,
                      max_ratio: float = 0.5) -> DataFrame:
    """Q8: flag estimates whose margin exceeds ``max_ratio`` of the estimate
    (or that lack one), and tentative geocodes (status 'T') when given."""
    unreliable = F.col(value).isNull() | F.col(moe).isNull() | (F.col(moe) > F.lit(max_ratio) * F.col(value))
    out = df.withColumn("unreliable", unreliable)
    if status is not None:
        out = out.withColumn("tentative", F.coalesce(F.col(status) == "T", F.lit(False)))
    return out
