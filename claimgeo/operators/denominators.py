"""Survey denominators: cleaning, strict sums, validation and roll-ups.

Denominator tables are one row per region x year (a few thousand counties or
~900 ZIP3s a year), so joins against them are broadcast-sized by nature; the
joins here still use plain equi joins and leave the choice to AQE, because a
ZCTA-level panel over many years can outgrow a safe broadcast.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import constants as K
from ..functions import scalars as X
from ..sources.csv import quoted, read_csv, typed
from . import aggregate as A


def survey_panel(raw: DataFrame, cells: list[str], margins: list[str],
                 keys: list[str] = ("year", "geoid"), sentinels=K.SURVEY_SENTINELS) -> DataFrame:
    """X15 + A16 + A17: clean the text cells, then the strict sum of the
    estimates and the margin of that sum (both NULL if any part is NULL)."""
    clean = raw.select(*keys,
                       *[X.clean_survey_number(c, sentinels).alias(c) for c in cells],
                       *[X.clean_survey_number(c, sentinels).alias(c) for c in margins])
    return clean.select(*keys, *cells, *margins,
                        X.strict_sum(cells).alias("medicaid_enrollees"),
                        X.margin_of_sum(margins).alias("medicaid_enrollees_moe"))


def panel_validation(panel: DataFrame, year: str = "year", value: str = "medicaid_enrollees",
                     geo: str | None = None) -> DataFrame:
    """Per (geo level,) year: rows, rows with a missing value, total of the present values."""
    keys = ([geo] if geo else []) + [year]
    return panel.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col(value).isNull()).alias("n_missing"),
        F.sum(value).alias("total"),
    )


def matrix_to_table(df: DataFrame, columns: list[str], rows_col: str = "value") -> DataFrame:
    """API replies ``[[header...], [row...], ...]`` (one JSON document
    per row of ``df``) -> the named columns, bound by each document's own
    header. A column that a document lacks raises; a reply that is no matrix
    raises, too."""
    m = F.from_json(F.col(rows_col), "ARRAY<ARRAY<STRING>>", {"mode": "FAILFAST"})
    arr = df.select(m.alias("m")).filter(F.size("m") > 0)
    body = arr.select(F.col("m")[0].alias("h"), F.explode(F.slice("m", 2, F.greatest(F.size("m") - 1, F.lit(0)))).alias("r"))

    def value(name: str):
        at = F.array_position("h", name)
        return F.when(at > 0, F.try_element_at("r", at.cast("int"))).otherwise(
            F.raise_error(F.lit(f"reply without column {name}")).cast("string"))
    return body.select(*[value(c).alias(c) for c in columns])


def read_enrollment(spark: SparkSession, path: str, id_col: str = "geoid", width: int = 5,
                    null_as_zero: bool = False, bad: str = "raise") -> DataFrame:
    """Enrollment CSV by header name; ids padded (X4), years as written;
    ``null_as_zero`` reproduces the reference's fill (D6). A count that does
    not parse raises unless ``bad="null"``."""
    df = read_csv(spark, path, [id_col, "year", "medicaid_enrollees"])
    v = typed("medicaid_enrollees", "double", bad).cast("bigint")
    if null_as_zero:
        v = F.coalesce(v, F.lit(0).cast("bigint"))
    return df.select(X.pad_id(F.trim(quoted(id_col)), width).alias("region_id"), F.trim("year").alias("year"),
                     v.alias("medicaid_enrollees"))


def read_or_empty(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet") -> DataFrame:
    """An optional source: the data, or an empty frame of ``schema`` when
    the path does not exist, so a left join gives NULL rates for that level.
    Any other failure raises."""
    try:
        return spark.read.schema(schema).format(fmt).load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def enrollment_by(df: DataFrame, level: str, parent_map: DataFrame | None = None,
                  strict: bool = True) -> DataFrame:
    """A19 (+J4): county -> state through the prefix map (an unmapped prefix
    raises; with ``strict=False`` it becomes a region of its own, so that the
    totals stay whole), county -> county, ZCTA -> 3-digit prefix."""
    if level == "county":
        return df.select("region_id", "year", "medicaid_enrollees")
    if level == "state":
        fn = A.strict_parent if strict else A.attach_parent
        j = fn(df, "region_id", parent_map, alias="parent")
        key = F.coalesce("parent", X.prefix("region_id", 2))
    elif level == "zip3":
        j = df
        key = F.substring("region_id", 1, 3)
    else:
        raise ValueError(level)
    return j.groupBy(key.alias("region_id"), "year").agg(
        F.sum("medicaid_enrollees").cast("bigint").alias("medicaid_enrollees"))


def attach_denominator(df: DataFrame, denom: DataFrame, key: str = "key", period: str = "period",
                       extra: list[str] = ()) -> DataFrame:
    """Left join of (``extra``..., region, year of the period) to the
    denominator; monthly periods reuse their year's value."""
    d = denom.select(*[F.col(c).alias(f"__{c}") for c in extra],
                     F.col("region_id").alias("__rid"), F.col("year").alias("__yr"), "medicaid_enrollees")
    cond = (F.col(key) == F.col("__rid")) & (X.period_year(period) == F.col("__yr"))
    for c in extra:
        cond = cond & (F.col(c) == F.col(f"__{c}"))
    j = df.join(d, cond, "left")
    return j.drop("__rid", "__yr", *[f"__{c}" for c in extra])
