"""Snapshot joins and id-set operators.

Scale notes
-----------
* Facts are first reduced to one row per (month, id) with a partial
  aggregate, so a sentinel id carrying a third of all claim rows becomes one
  row per month before any join shuffle. All id-set logic runs on that.
* J6 (±N months) explodes the 2N offsets on the dropped side and uses an
  equi ``left_semi`` join on (id, month index): no range or theta join.
* J7 (nearest month) never pairs each dropped month with each present month
  of an id: dropped and present months of an id are merged in one window
  partitioned by id and ordered by month, and the previous/next present
  month come from ``last``/``first`` with ``ignorenulls``. A partition is
  one id's months (bounded by the calendar), not a hot group of rows.
* Id sets (U1, U2) stay DataFrames; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as X


def filter_code_prefix(df: DataFrame, col: str = "code", prefix: str = "D") -> DataFrame:
    """keep rows whose code starts with ``prefix``; NULL codes drop. The
    predicate is pushed to the Parquet scan as ``StringStartsWith``."""
    return df.filter(F.col(col).startswith(prefix))


def snapshot_join(facts: DataFrame, snaps: DataFrame, fid: str = "servicing_id", fym: str = "year_month",
                  sid: str = "npi", sym: str = "ym") -> DataFrame:
    """Same-month inner equi join; NULL ids never match."""
    return facts.join(snaps, (facts[fid] == snaps[sid]) & (facts[fym] == snaps[sym]), "inner")


def id_months(facts: DataFrame, fid: str = "servicing_id", fym: str = "year_month",
              measures: tuple[str, ...] = ()) -> DataFrame:
    """(month, id) -> row count (+ sums); the NULL id is a group of its own."""
    aggs = [F.count(F.lit(1)).alias("n_rows")] + [F.sum(m).alias(m) for m in measures]
    g = facts.groupBy(F.col(fym).alias("year_month"), F.col(fid).alias("servicing_id")).agg(*aggs)
    # The filter reads an aggregate output (always true), so it stays above
    # the aggregate and Catalyst cannot move later semi/anti joins on the
    # grouping keys below it: the joins then shuffle (month, id) groups,
    # not raw claim rows, and a hot id never reaches a join un-aggregated.
    return g.filter(F.col("n_rows") > 0).withColumn("mi", X.month_index("year_month"))


def ever_seen(snaps: DataFrame, sid: str = "npi") -> DataFrame:
    """Every id present in any month."""
    return snaps.select(F.col(sid).alias("npi")).filter(F.col("npi").isNotNull()).distinct()


def mark_presence(facts_by_id: DataFrame, snaps: DataFrame, sid: str = "npi", sym: str = "ym") -> DataFrame:
    """The (month, id) groups of :func:`id_months` with ``same_rows`` (snapshot
    rows of the id in that month), ``prev_mi`` / ``next_mi`` (the nearest
    earlier and later month in which the id is present) and ``in_same_month``
    / ``in_any_month``. J5, J6, J7 and J13 are columns and filters of it.

    Facts and snapshot rows of an id meet once, in one window over the id's
    months; facts arrive as one row per (month, id), so a hot id holds no more
    rows than there are months. NULL ids are never present. Each side is read
    once and shuffled once (the facts also for their aggregate).
    """
    mi = F.col("mi") if "mi" in snaps.columns else X.month_index(sym)
    extra = [c for c in facts_by_id.columns if c not in ("year_month", "servicing_id", "mi")]
    seen = (snaps.filter(F.col(sid).isNotNull())
            .select(F.lit(None).cast("string").alias("year_month"), F.col(sid).alias("servicing_id"), mi.alias("mi"),
                    *[F.lit(None).cast(facts_by_id.schema[c].dataType).alias(c) for c in extra], F.lit(1).alias("k")))
    events = facts_by_id.select("year_month", "servicing_id", "mi", *extra, F.lit(0).alias("k")).unionByName(seen)
    w = Window.partitionBy("servicing_id").orderBy("mi")
    present = F.when(F.col("k") == 1, F.col("mi"))
    marked = events.select(
        "*", F.sum("k").over(w.rangeBetween(0, 0)).alias("same_rows"),
        F.max(present).over(w.rangeBetween(Window.unboundedPreceding, -1)).alias("prev_mi"),
        F.min(present).over(w.rangeBetween(1, Window.unboundedFollowing)).alias("next_mi"))
    same = F.col("same_rows") > 0
    return marked.filter("k = 0").drop("k").select(
        "*", same.alias("in_same_month"),
        (same | F.col("prev_mi").isNotNull() | F.col("next_mi").isNotNull()).alias("in_any_month"))


def merged_rows_by_month(marked: DataFrame) -> DataFrame:
    """Rows the same-month inner join (J1) produces, per month, without
    joining raw rows: each group's row count times the snapshot rows of that
    (id, month). Duplicate snapshot rows multiply the count exactly as the row
    join does (D2)."""
    return (marked.filter("in_same_month").groupBy("year_month")
            .agg(F.sum(F.col("n_rows") * F.col("same_rows")).alias("merged_rows")))


def dropped_ids(marked: DataFrame) -> DataFrame:
    """(month, id) groups with no same-month snapshot row; the NULL id is
    always dropped."""
    return marked.filter(~F.col("in_same_month"))


def month_distance() -> Column:
    """Months from a marked group to the nearest other month with its id."""
    return F.least(F.col("mi") - F.col("prev_mi"), F.col("next_mi") - F.col("mi")).cast("int")


def recoverable(dropped: DataFrame, window: int = 1) -> DataFrame:
    """Dropped groups whose id is present in a month within ±``window``
    (the same month excluded)."""
    return dropped.filter(month_distance() <= window)


def nearest_month(dropped: DataFrame) -> DataFrame:
    """For each dropped (month, non-NULL id), the closest month in
    which the id is present and the distance; ties go to the earlier month.
    ``nearest_ym`` / ``distance`` are NULL when the id is never present."""
    before, after = F.col("mi") - F.col("prev_mi"), F.col("next_mi") - F.col("mi")
    best = F.when(after.isNull() | (before <= after), F.col("prev_mi")).otherwise(F.col("next_mi"))
    return dropped.filter(F.col("servicing_id").isNotNull()).select(
        "year_month", "servicing_id", "n_rows", X.month_from_index(best, dashed=True).alias("nearest_ym"),
        month_distance().alias("distance"))


def month_coverage(fact_months: DataFrame, snap_months: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """Months with snapshots but no claims, claims but no snapshot, or
    both; with ``done`` (a tracker of processed months) also whether each
    month is already done."""
    f = fact_months.select(F.col(fact_months.columns[0]).alias("ym")).distinct().withColumn("in_claims", F.lit(True))
    s = snap_months.select(F.col(snap_months.columns[0]).alias("ym")).distinct().withColumn("in_snapshots", F.lit(True))
    j = f.join(s, "ym", "full_outer").select(
        "ym", F.coalesce("in_claims", F.lit(False)).alias("in_claims"),
        F.coalesce("in_snapshots", F.lit(False)).alias("in_snapshots"))
    if done is not None:
        dn = done.select(F.col(done.columns[0]).alias("ym")).distinct().withColumn("done", F.lit(True))
        j = j.join(dn, "ym", "left").withColumn("done", F.coalesce("done", F.lit(False)))
    status = (F.when(F.col("in_claims") & F.col("in_snapshots"), "both")
              .when(F.col("in_claims"), "claims_only").otherwise("snapshot_only"))
    return j.withColumn("status", status)


def stable_sample(df: DataFrame, key: str, n: int, seed: str = "42") -> DataFrame:
    """``n`` rows ordered by ``md5(key || seed)`` then key: the same rows
    for any partitioning and in any engine with md5."""
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(seed))), F.col(key)).limit(n)
