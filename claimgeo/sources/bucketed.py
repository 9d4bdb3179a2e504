"""Tables bucketed by id inside each month.

Claims and registry landed with the same number of buckets join month by
month without an exchange: a task of the join reads one bucket of either
side. The number of buckets is fixed when they are written; take it so that a
bucket of the claims fits a task (``buckets_for``; ``buckets_for_rows`` where
a scan reads more than one month).

A bucketed join cannot split a hot id, and ids that stand for "unknown" are
the hot ones. They are kept out of it by their class: an id that is not ten
digits, or one digit repeated, is in no registry (``is_matchable``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.snapshot import snapshot_join


def buckets_for(input_bytes: int, months: int = 1, target_bytes: int = 256 * 1024 ** 2) -> int:
    """Buckets a month for claims of ``input_bytes`` over ``months`` when a
    task reads one bucket of one month; a power of two, so that tables of
    different counts still line up."""
    n = max(1, -(-input_bytes // (max(1, months) * target_bytes)))
    return 1 << (n - 1).bit_length()


def buckets_for_rows(rows: int, rows_a_bucket: int = 2_000_000, least: int = 4) -> int:
    """Buckets for tables of ``rows`` rows in all whose months are read
    together: a bucketed scan gives one bucket of all months to one task,
    which sorts it. A power of two, as in :func:`buckets_for`."""
    return max(least, 1 << (max(1, -(-rows // rows_a_bucket)) - 1).bit_length())


def is_matchable(sid: str | Column) -> Column:
    """Ids that a registry can hold: ten digits, not all the same. NULL is not."""
    c = F.col(sid) if isinstance(sid, str) else sid
    return F.coalesce(c.rlike(r"\A[0-9]{10}\z") & ~c.rlike(r"\A([0-9])\1{9}\z"), F.lit(False))


def write_bucketed(df: DataFrame, table: str, path: str, key: str, month: str, buckets: int) -> None:
    """``df`` as an external Parquet table at ``path``, one folder a month and
    ``buckets`` buckets by ``key`` in each, each bucket sorted by ``key``.
    Rows are dealt by (month, bucket) first, large ones over several tasks,
    so a month has about as many files as buckets."""
    spare = "__bucket"
    dealt = df.withColumn(spare, F.pmod(F.hash(key), F.lit(buckets))).hint("rebalance", month, spare).drop(spare)
    (dealt.write.mode("overwrite").option("path", path).partitionBy(month).bucketBy(buckets, key).sortBy(key)
     .format("parquet").saveAsTable(table))


def attach_bucketed(spark: SparkSession, table: str, path: str, schema: str, key: str, month: str, buckets: int) -> DataFrame:
    """The table that :func:`write_bucketed` left at ``path``, made known to a
    session whose catalog does not hold it."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({schema}) USING parquet PARTITIONED BY ({month}) "
              f"CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{path}'")
    spark.sql(f"ALTER TABLE {table} RECOVER PARTITIONS")
    return spark.table(table)


def bucketed_snapshot_join(facts: DataFrame, snaps: DataFrame, fid: str = "servicing_id", fym: str = "year_month",
                           sid: str = "npi", sym: str = "ym") -> DataFrame:
    """J1 over two tables bucketed by id: same-month inner join of the rows
    whose id a registry can hold. The month is a second join key that the
    buckets do not cover; the session is told that co-location by id does
    (a planner setting, no result depends on it)."""
    facts.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return snapshot_join(facts.filter(is_matchable(fid)), snaps.filter(is_matchable(sid)), fid, fym, sid, sym)
