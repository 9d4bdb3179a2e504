"""Write, audit, publish: outputs become visible only after their checks hold.

The six outputs (K4) are written to a staging folder of the target's parent,
read back as the text that users will get, and audited there (A3): no key on
two lines, no (key, period, category) twice, annual sums equal to those of the
months, state sums equal to those of the counties. Only then is the staging
folder moved to the target, in one rename of the shared file system; what was
published before is set aside first and put back if the rename fails. A
failed audit raises :class:`AuditError`, leaves the target as it was and the
staging folder in place for a look.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.aggregate import LEVEL_KEYS, MEASURES, attach_parent, duplicate_keys, output_invariants, parse_ndjson_lines
from .sinks import write_all_outputs

GRAINS = {"annual": "year", "monthly": "year_month"}


class AuditError(ValueError):
    """Checks that do not hold: ``(check, level, n_bad)`` each."""

    def __init__(self, staging: str, failures: list[tuple[str, str, int]]):
        super().__init__(f"not published, see {staging}: {failures}")
        self.staging, self.failures = staging, failures


def read_outputs(spark: SparkSession, root: str) -> DataFrame:
    """The stored outputs as ``(grain, level, key, period, category, sums)``,
    read from their lines; a line that is no record raises."""
    out = None
    for name, period in GRAINS.items():
        for level in LEVEL_KEYS:
            rows = parse_ndjson_lines(spark.read.text(f"{root}/{name}_{level}"), period).select(
                F.lit(period).alias("grain"), F.lit(level).alias("level"), "key", "period", "category", *MEASURES)
            out = rows if out is None else out.unionByName(rows)
    return out


def repeated_lines(spark: SparkSession, root: str) -> DataFrame:
    """``(level, n_bad)``: keys on more than one line, over both grains."""
    out = None
    for name in GRAINS:
        for level in LEVEL_KEYS:
            d = duplicate_keys(spark.read.text(f"{root}/{name}_{level}")).select(F.lit(level).alias("level"))
            out = d if out is None else out.unionByName(d)
    return out.groupBy("level").agg(F.count(F.lit(1)).alias("n_bad"))


def state_is_counties(outputs: DataFrame, fips_map: DataFrame) -> DataFrame:
    """One row ``(level, check, n_bad)``: state records, of either grain, that
    differ from the sums of their counties (a missing side counts as 0).
    Counties of a prefix without a state are in no state record."""
    county = attach_parent(outputs.filter("level = 'county'"), "key", fips_map, alias="parent").filter("parent IS NOT NULL")
    signed = outputs.filter("level = 'state'").select("grain", "key", "period", "category", *MEASURES).unionByName(
        county.select("grain", F.col("parent").alias("key"), "period", "category", *[(-F.col(m)).alias(m) for m in MEASURES]))
    left = signed.groupBy("grain", "key", "period", "category").agg(*[F.sum(m).alias(m) for m in MEASURES])
    differs = F.lit(False)
    for m in MEASURES:
        differs = differs | (F.col(m) != 0)
    return left.agg(F.count_if(differs).alias("n_bad")).select(
        F.lit("state").alias("level"), F.lit("state_is_counties").alias("check"), "n_bad")


def audit(spark: SparkSession, root: str, fips_map: DataFrame, outputs: DataFrame | None = None) -> DataFrame:
    """A3 on stored files: ``(level, check, n_bad, ok)``, ten rows.
    ``outputs``: their records, if the caller keeps them."""
    outputs = read_outputs(spark, root) if outputs is None else outputs
    levels = spark.createDataFrame([(x,) for x in LEVEL_KEYS], "level string")
    lines = levels.join(repeated_lines(spark, root), "level", "left").select(
        "level", F.lit("one_line_a_key").alias("check"), F.coalesce("n_bad", F.lit(0)).alias("n_bad"))
    inside = levels.select("level", F.explode(F.array(F.lit("grain_unique"), F.lit("annual_is_months"))).alias("check")).join(
        output_invariants(outputs).drop("ok"), ["level", "check"], "left").select(
        "level", "check", F.coalesce("n_bad", F.lit(0)).alias("n_bad"))
    checks = lines.unionByName(inside).unionByName(state_is_counties(outputs, fips_map))
    return checks.select("level", "check", F.col("n_bad").cast("bigint").alias("n_bad"), (F.col("n_bad") == 0).alias("ok"))


def rename(spark: SparkSession, src: str, dst: str) -> None:
    """Move a folder within its shared file system."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(src)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.rename(path, jvm.org.apache.hadoop.fs.Path(dst)):
        raise OSError(f"cannot rename {src} to {dst}")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def publish_staged(spark: SparkSession, staging: str, target: str, fips_map: DataFrame) -> DataFrame:
    """Audit what lies in ``staging`` and move it to ``target`` if every check
    holds. Returns the checks. What was at ``target`` stays as
    ``<target>.before-<n>``."""
    outputs = read_outputs(spark, staging).persist()       # several checks read the records, which are parsed once
    try:
        rows = [(r.level, r.check, r.n_bad, r.ok) for r in audit(spark, staging, fips_map, outputs).collect()]
    finally:
        outputs.unpersist()
    failures = [(c, level, n) for level, c, n, ok in rows if not ok]
    if failures:
        raise AuditError(staging, failures)
    before = f"{target}.before-{uuid.uuid4().hex}"
    had = exists(spark, target)
    if had:
        rename(spark, target, before)
    try:
        rename(spark, staging, target)
    except Exception:
        if had:
            rename(spark, before, target)
        raise
    return spark.createDataFrame(rows, "level string, check string, n_bad bigint, ok boolean")


def publish_outputs(base: DataFrame, target: str, fips_map: DataFrame) -> DataFrame:
    """Write the six outputs of ``base`` to a new staging folder beside
    ``target``, audit the stored files, publish them. Returns the checks."""
    spark = base.sparkSession
    staging = f"{target.rstrip('/')}.staging-{uuid.uuid4().hex}"
    write_all_outputs(base, staging)
    return publish_staged(spark, staging, target.rstrip("/"), fips_map)
