"""Address de-duplication and concentration (A5, O1, A28, X7–X9 in use).

Address rows are reduced to one row per normalised address before anything
expensive (the geocoder hand-off). The group-by runs as Spark's partial +
final hash aggregate, so each executor pre-aggregates its split before the
shuffle; a hot address (one key with a third of all rows) costs one row per
map task in the shuffle, never a skewed partition of raw rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as X

ADDRESS_PARTS = [
    "practice_address_line_1",
    "practice_address_line_2",
    "practice_city",
    "practice_state",
    "practice_zip5",
]


def dedupe_addresses(df: DataFrame, parts: list[str] = ADDRESS_PARTS,
                     claims: str = "claims", paid: str = "paid") -> DataFrame:
    """A5: one row per normalised address.

    ``n_rows`` / ``n_claims`` / ``total_paid`` are summed; each raw part is the
    minimum non-null raw value of the group (a deterministic stand-in for
    "first seen", which would depend on file order).
    """
    norm = [X.normalize_text(p).alias(f"{p}__n") for p in parts]
    g = df.select(*parts, claims, paid, *norm)
    agg = g.groupBy(*[f"{p}__n" for p in parts]).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(F.sum(claims), F.lit(0)).cast("bigint").alias("n_claims"),
        F.coalesce(F.sum(paid), F.lit(0)).cast("decimal(38,2)").alias("total_paid"),
        *[F.min(p).alias(p) for p in parts],
    )
    return agg.select(
        F.md5(F.concat_ws("|", *[F.col(f"{p}__n") for p in parts])).alias("address_id"),
        X.address_full(*parts).alias("address_full"),
        *parts,
        "n_rows", "n_claims", "total_paid",
    )


def top_addresses(addresses: DataFrame, n: int | None = None) -> DataFrame:
    """O1: the addresses in priority order (claims descending, ties by id):
    all of them, or the first ``n`` for a top-k report."""
    ordered = addresses.orderBy(F.desc("n_claims"), F.asc("address_id"))
    return ordered if n is None else ordered.limit(n)


MANTISSA_BITS = 10


def value_bucket(v: Column) -> Column:
    """A bucket number that grows with the value: its binary exponent and
    first ``MANTISSA_BITS`` bits (values below ``2 ** (MANTISSA_BITS + 1)``
    have one each). At most 64 * 2 ** MANTISSA_BITS on either side of zero."""
    size = F.abs(F.floor(v)).cast("bigint")
    shift = F.greatest(F.length(F.bin(size)) - 1 - MANTISSA_BITS, F.lit(0))
    bucket = shift * (1 << MANTISSA_BITS) + F.floor(size / F.pow(F.lit(2.0), shift)).cast("bigint")
    return F.when(v < 0, -bucket - 1).otherwise(bucket)


def concentration(addresses: DataFrame, value: str = "n_claims",
                  shares: tuple[int, ...] = (1, 10)) -> DataFrame:
    """Share of ``value`` held by the top 1 % / 10 % of addresses
    (``max(1, n * share // 100)`` of them by value), plus the row-reduction
    factor ``rows / addresses``. One row; a share is NULL without any value.

    The sum over the top k does not depend on how ties are ordered, so no
    rank is made: addresses are counted per distinct value, values are
    numbered inside buckets of near values (a deterministic function of the
    value, so any partitioning gives the same result), and bucket totals,
    a bounded table, give what lies above each bucket. NULL values count as 0.
    """
    rows = addresses.select(F.coalesce(F.col(value), F.lit(0)).alias("v"), F.col("n_rows").alias("r"))
    hist = rows.groupBy("v").agg(F.count(F.lit(1)).alias("c"), F.sum("r").alias("r")).withColumn("b", value_bucket(F.col("v")))
    totals = hist.groupBy("b").agg(F.sum("c").alias("n"))                    # bounded: see value_bucket
    above = totals.select("b", (F.sum("n").over(Window.orderBy(F.desc("b"))) - F.col("n")).alias("above"))
    inside = hist.withColumn("before", F.sum("c").over(Window.partitionBy("b").orderBy(F.desc("v"))) - F.col("c"))
    placed = inside.join(F.broadcast(above), "b").withColumn("before", F.col("before") + F.col("above"))
    n = addresses.select(F.count(F.lit(1))).scalar()
    exprs = [F.coalesce(F.sum("c"), F.lit(0)).alias("n_addresses"), F.sum("r").alias("n_rows"),
             F.sum(F.col("v") * F.col("c")).alias("total_value")]
    for s in shares:
        kth = F.greatest(F.lit(1), F.floor(n * F.lit(s) / F.lit(100)))
        taken = F.greatest(F.lit(0), F.least(F.col("c"), kth - F.col("before")))
        exprs.append(F.sum(F.col("v") * taken).alias(f"top{s}_value"))
    cols = [F.col("n_addresses"), F.col("n_rows").cast("bigint").alias("n_rows"),
            F.round(F.try_divide("n_rows", "n_addresses"), 6).alias("reduction_factor")]
    for s in shares:
        cols.append(F.round(F.try_divide(F.lit(100.0) * F.col(f"top{s}_value"), F.col("total_value")), 6)
                    .alias(f"top{s}_pct"))
    return placed.agg(*exprs).select(*cols)


def address_key(df: DataFrame, parts: list[str] = ADDRESS_PARTS) -> Column:
    """The address id of each row (X8 over the address parts)."""
    return X.address_id(parts)
