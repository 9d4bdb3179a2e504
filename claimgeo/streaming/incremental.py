"""Resumable month processing with Structured Streaming.

Input is a month-partitioned Parquet directory that grows over time. A file
stream with ``trigger(availableNow=True)`` processes whatever arrived since
the last run; the checkpoint is the tracker of processed files. For each
micro-batch, ``foreachBatch`` takes the months the new files touch, re-reads
*all* input of those months (a partition-pruned batch read) and overwrites
just those output partitions. A late file for an already-processed month
therefore rebuilds that month from all its files rather than replacing it
with the late rows only, and re-running a batch after a failure writes the
same result (idempotent).

A manifest, if one is named, tells the finished months: one row a month with
the input files that its output was made of. It is written after the month's
output, so a month whose job died in between is not listed, and any job can
bring the output up to date by :func:`build_months`: the months whose input
files are not those of the manifest, or, by ``force``, all that it is asked for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.sinks import month_files, write_by_month

MANIFEST = "n_files long, n_bytes long, files long, made_by string"


def touched_months(batch: DataFrame, month_col: str = "ym") -> list[str]:
    """The months of a batch: a calendar-bounded list, small enough to name."""
    return sorted(r[0] for r in batch.select(month_col).distinct().collect() if r[0] is not None)


def months_of(spark: SparkSession, src: str, schema: StructType, months: list[str], month_col: str = "ym") -> DataFrame:
    """All input rows of the named months: a literal filter on the partition
    column, so only their folders are listed and read."""
    return spark.read.schema(schema).parquet(src).filter(F.col(month_col).isin(months))


def input_state(spark: SparkSession, src: str, month_col: str = "ym") -> DataFrame:
    """``(<month_col>, n_files, n_bytes, files)`` per month folder of ``src``;
    ``files`` is a hash of its files' paths, sizes and times."""
    return (month_files(spark, src, month_col).groupBy(month_col)
            .agg(F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("n_bytes"),
                 F.bit_xor(F.xxhash64("path", "length", "modified")).alias("files")))


def finished_months(spark: SparkSession, manifest: str, month_col: str = "ym") -> DataFrame:
    """The manifest's rows, one per finished month (none while there is no
    manifest)."""
    files = month_files(spark, manifest, month_col)
    schema = f"{month_col} string, {MANIFEST}"
    if files.isEmpty():
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(manifest).select(month_col, "n_files", "n_bytes", "files", "made_by")


def stale_months(spark: SparkSession, src: str, manifest: str, month_col: str = "ym") -> DataFrame:
    """Months of ``src`` that are not finished, or not from the files that are
    there now."""
    done = finished_months(spark, manifest, month_col).select(month_col, "files")
    return input_state(spark, src, month_col).join(done, [month_col, "files"], "left_anti").select(month_col)


def write_months(spark: SparkSession, src: str, dst: str, schema: StructType, transform: Callable[[DataFrame], DataFrame],
                 months: list[str], month_col: str = "ym", manifest: str | None = None, made_by: str = "") -> None:
    """Rebuild the output of the named months from all their input, then list
    them in the manifest with the files seen before the input was read (one
    that arrives meanwhile makes its month stale again)."""
    if not months:
        return
    state = None
    if manifest is not None:                                    # a row a month
        seen = input_state(spark, src, month_col).filter(F.col(month_col).isin(months)).withColumn("made_by", F.lit(made_by))
        state = spark.createDataFrame(seen.collect(), seen.schema)
    write_by_month(transform(months_of(spark, src, schema, months, month_col)), dst, month_col)
    if state is not None:
        write_by_month(state.coalesce(1), manifest, month_col)


def build_months(spark: SparkSession, src: str, dst: str, manifest: str, schema: StructType,
                 transform: Callable[[DataFrame], DataFrame], months: list[str] | None = None, force: bool = False,
                 month_col: str = "ym") -> list[str]:
    """Bring the output of ``months`` (default: all of ``src``) up to date and
    return the months rebuilt: the stale ones, or with ``force`` every one
    that has input. A wanted month without input is not built."""
    todo = input_state(spark, src, month_col).select(month_col) if force else stale_months(spark, src, manifest, month_col)
    names = touched_months(todo, month_col)
    if months is not None:
        names = [m for m in names if m in set(months)]
    write_months(spark, src, dst, schema, transform, names, month_col, manifest, "forced" if force else "build")
    return names


def run_incremental(spark: SparkSession, src: str, dst: str, checkpoint: str, schema: StructType,
                    transform: Callable[[DataFrame], DataFrame], month_col: str = "ym", manifest: str | None = None) -> None:
    """Process every month whose input changed since the last run, and list
    it in the ``manifest``, if one is named.

    ``schema`` is the input schema including the partition column
    ``month_col``; ``transform`` maps all input rows of some months to the
    output rows of those months (it must keep ``month_col``).
    """
    def process(batch: DataFrame, batch_id: int) -> None:
        write_months(spark, src, dst, schema, transform, touched_months(batch, month_col), month_col, manifest, f"batch {batch_id}")

    q = (spark.readStream.schema(schema).parquet(src)
         .writeStream.foreachBatch(process)
         .option("checkpointLocation", checkpoint)
         .trigger(availableNow=True)
         .start())
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
