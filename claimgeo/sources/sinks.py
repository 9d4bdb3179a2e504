"""Sinks (K1–K3, K5, K6, K8, K9).

Writes are distributed: each task writes its own part files. Month-partitioned
outputs use dynamic partition overwrite, so re-running a month replaces only
that month (idempotent, safe to retry after a lost executor).
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.aggregate import LEVEL_KEYS, multi_level_aggregate, ndjson_lines
from .csv import write_csv_files


def write_by_month(df: DataFrame, path: str, ym: str = "ym", mode: str = "overwrite") -> None:
    """K1/K2: one Parquet directory per month; ``overwrite`` replaces only
    the months present in ``df`` (dynamic partition overwrite)."""
    (df.write.mode(mode).option("partitionOverwriteMode", "dynamic")
       .partitionBy(ym).parquet(path))


def write_ndjson(agg: DataFrame, path: str, period_field: str = "year") -> DataFrame:
    """K3 + A27: keyed NDJSON lines (one per key, in key order, sorted
    records) written as text; returns the (#keys, #records) counts as a one-row DataFrame."""
    seen = Observation()
    # Counted while it is written, above the sort (which samples what is below).
    lines = ndjson_lines(agg, period_field).orderBy("key").observe(
        seen, F.count(F.lit(1)).alias("n_keys"), F.sum("n_records").alias("n_records"))
    lines.select("line").write.mode("overwrite").text(path)
    counts = seen.get
    return agg.sparkSession.createDataFrame([(counts["n_keys"], counts["n_records"])], "n_keys bigint, n_records bigint")


def write_csv(df: DataFrame, path: str, columns: list[str], order: list[str] | None = None) -> None:
    """K5/K6/K8: pinned column order, header, NULL written as an empty field,
    values with a quote, comma or line break quoted with doubled quotes,
    blanks kept; ``order`` sorts the output over its part files."""
    out = df.select(*columns)
    if order:
        out = out.orderBy(*order)
    write_csv_files(out, path)


def write_id_cache(snaps: DataFrame, path: str, sid: str = "npi", ym: str = "ym") -> None:
    """K9: the (id, month) projection of the snapshots, partitioned by month."""
    write_by_month(snaps.select(F.col(sid).alias("npi"), F.col(ym).alias("ym")).dropna(subset=["npi"]), path)


def month_files(spark: SparkSession, path: str, ym: str = "ym") -> DataFrame:
    """``(<ym>, path, length, modified)`` of the data files under the month
    folders of ``path``: a listing, no file is opened. Without the folder
    there are none; any other failure raises."""
    try:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option(
            "recursiveFileLookup", "true").load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{ym} string, path string, length long, modified timestamp")
    month = F.regexp_extract("path", f"/{ym}=([^/]+)/", 1)
    return files.select(month.alias(ym), "path", "length", F.col("modificationTime").alias("modified")).filter(month != "")


def missing_months(wanted: DataFrame, done_path: str, spark=None, ym: str = "ym") -> DataFrame:
    """Months of ``wanted`` that have no partition under ``done_path``
    (all of them while nothing is there), by a listing of its folders."""
    done = month_files(spark or wanted.sparkSession, done_path, ym).select(ym).distinct()
    return wanted.select(ym).distinct().join(done, ym, "left_anti")


def write_report(df: DataFrame, path: str, order: list[str]) -> None:
    """K8: a sorted report as CSV with a header; the part files follow the
    order, as many as the report's size asks for."""
    write_csv(df, path, df.columns, order)


def write_all_outputs(base: DataFrame, root: str) -> DataFrame:
    """K4 + K3 + A27: the six keyed-NDJSON outputs {annual, monthly} x
    {state, county, zip3} from one multi-level aggregate.

    The aggregate is persisted (lineage kept: a lost executor recomputes its
    blocks) and each output is a filter of it, so the claim rows are read and
    shuffled once for all six. Returns (output, n_keys, n_records): six rows,
    counted while the aggregate is still cached."""
    multi = multi_level_aggregate(base, LEVEL_KEYS, ("year", "year_month")).persist()
    try:
        rows = []
        for grain, name in (("year", "annual"), ("year_month", "monthly")):
            for level in LEVEL_KEYS:
                out = multi.filter((F.col("grain") == grain) & (F.col("level") == level)).select(
                    "key", "period", "category", "total_beneficiaries_served", "total_claims", "total_amount_paid")
                c = write_ndjson(out, f"{root}/{name}_{level}", grain).collect()[0]
                rows.append((f"{name}_{level}", int(c.n_keys), int(c.n_records or 0)))
        return base.sparkSession.createDataFrame(rows, "output string, n_keys bigint, n_records bigint")
    finally:
        multi.unpersist()
