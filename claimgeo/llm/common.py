"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage: materialise ``df`` in the shared checkpoint folder, so a
    lost executor costs a re-read, not a recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def free_shuffles(spark: SparkSession) -> None:
    """Spark deletes the shuffle files of a DataFrame that is no longer held
    when the driver's JVM collects it, which may be long after: ask for it
    between the steps of a long job."""
    spark.sparkContext._jvm.System.gc()


def texts(docs: DataFrame, text_col: str = "text"):
    """The text column with nulls as empty text."""
    return F.coalesce(F.col(text_col), F.lit(""))


def free_name(docs: DataFrame, stem: str) -> str:
    """A name for a helper column that no column of ``docs`` has."""
    taken = {c.lower() for c in docs.columns}
    while stem in taken:
        stem += "_"
    return stem


def columns(docs: DataFrame) -> list[Column]:
    """The columns of ``docs``, for a select; names may hold dots and backticks."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]


def batch(columns: dict[str, pa.Array | list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=schema.field(n).type) for n, c in columns.items()],
        schema=schema)


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Regroup a stream of batches sorted by ``keys`` so that no group of
    equal keys straddles two of the tables yielded. Holds one batch and one
    group at a time."""
    held: pa.Table | None = None
    for b in batches:
        if b.num_rows == 0:
            continue
        t = pa.Table.from_batches([b])
        held = t if held is None else pa.concat_tables([held, t])
        last = {k: held.column(k)[held.num_rows - 1].as_py() for k in keys}
        first = {k: held.column(k)[0].as_py() for k in keys}
        if first == last:
            continue
        lo, hi = 0, held.num_rows - 1          # first row of the last group, by bisection over the sorted rows
        while lo < hi:
            mid = (lo + hi) // 2
            if {k: held.column(k)[mid].as_py() for k in keys} == last:
                hi = mid
            else:
                lo = mid + 1
        yield held.slice(0, lo)
        held = held.slice(lo).combine_chunks()
    if held is not None:
        yield held
