"""The CSV dialect of all text sources and sinks: header, doubled quotes,
blanks kept, columns bound by header name and read as text.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

DIALECT = {"header": "true", "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false",
           "ignoreTrailingWhiteSpace": "false"}
READ = {**DIALECT, "inferSchema": "false", "mode": "FAILFAST", "nullValue": ""}
WRITE = {**DIALECT, "nullValue": "", "emptyValue": ""}


def quoted(name: str) -> Column:
    """A column whose name may hold dots."""
    return F.col(f"`{name}`")


def read_csv(spark: SparkSession, path: str | list[str], columns: list[str] | None = None,
             multi_line: bool = False) -> DataFrame:
    """CSV files of one header, every column as text. ``columns`` are required
    and selected by name (all, if omitted). A file whose header differs from
    the first one's raises when it is read (Spark checks each file's header
    against the schema). Fields with line breaks need ``multi_line``, which
    reads each file in one task."""
    reader = spark.read.options(**READ, multiLine=str(multi_line).lower(), enforceSchema="false")
    names = reader.csv(path).columns
    df = reader.schema(StructType([StructField(n, StringType()) for n in names])).csv(path)
    if columns is None:
        return df
    require_columns(df, columns)
    return df.select(*[quoted(c) for c in columns])


def read_csv_groups(spark: SparkSession, path_glob: str, multi_line: bool = False) -> list[DataFrame]:
    """Files of several headers: one text DataFrame per header, each with the
    ``_metadata`` of its files. One job finds each file's first line that is
    not blank (collected: a line a file), and one job per distinct header
    reads it. Files without a line hold nothing and are in no group."""
    lines = spark.read.text(path_glob).filter(F.trim("value") != "").select(
        "value", F.col("_metadata.file_path").alias("path"),
        F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("place"))
    firsts = lines.groupBy("path").agg(F.min_by("value", "place").alias("header"))
    groups: dict[str, list[str]] = defaultdict(list)
    for r in firsts.orderBy("path").collect():
        groups[r.header].append(r.path)
    return [read_csv(spark, files, multi_line=multi_line) for files in groups.values()]


def require_columns(df: DataFrame, columns: list[str]) -> None:
    """Raise ``KeyError`` naming the required columns that are missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"missing required columns: {missing}")


def typed(name: str, kind: str, bad: str = "raise") -> Column:
    """Text as a number. Blank is NULL; text that is no such number raises,
    or is NULL too with ``bad="null"``."""
    text = F.trim(quoted(name))
    value = text.try_cast(kind)
    if bad == "null":
        return value
    message = F.concat(F.lit(f"{name}: not a {kind}: "), text)
    return F.when(value.isNotNull() | text.isNull() | (text == ""), value).otherwise(F.raise_error(message).cast(kind))


def write_csv_files(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(**WRITE).csv(path)
