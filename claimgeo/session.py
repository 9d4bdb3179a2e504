"""Session helpers.

On a cluster the session already exists and names its shared checkpoint
folder in ``spark.checkpoint.dir``; we only read it. Local runs (tests,
bench) get a session with settings sized for one machine and, when unset,
a fresh scratch checkpoint folder.
"""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.session.timeZone": "UTC",
    # Small local inputs: keep the size-checked broadcast for dimensions
    # but stop a file-size estimate from broadcasting a fact table.
    "spark.sql.autoBroadcastJoinThreshold": str(2 * 1024 * 1024),
    # A few hundred month directories are listed faster on the driver than
    # by a listing job.
    "spark.sql.sources.parallelPartitionDiscovery.threshold": "1024",
}


def get_spark(master: str = "local[8]", extra: dict | None = None) -> SparkSession:
    b = SparkSession.builder.master(master).appName("claimgeo")
    for k, v in {**DEFAULTS, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session. Where it names none, a
    scratch folder is set on a local master (tests, bench); on a cluster that
    is an error, since a machine-local folder would not be shared."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="claimgeo-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


def size_for_input(spark: SparkSession, input_bytes: int, target_partition_bytes: int = 256 * 1024 ** 2) -> dict:
    """Size shuffles and splits for an input of ``input_bytes`` (e.g. the
    month-partitioned claims at ~100 TB) and apply the runtime SQL settings:

    * initial shuffle partitions = input / target (AQE then coalesces small
      ones to the advisory size, so the count is an upper bound that keeps
      every reducer's partition near ``target_partition_bytes`` and spills
      bounded);
    * file splits of the same target size;
    * skew join on, with a skewed partition defined relative to the median.

    Returns the settings it applied. Nothing here changes results.
    """
    n = max(200, -(-input_bytes // target_partition_bytes))
    conf = {
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(target_partition_bytes),
    }
    for k, v in conf.items():
        spark.conf.set(k, v)
    return conf


def room_for(spark: SparkSession, rows: int, rows_a_partition: int = 500_000) -> int:
    """At least so many shuffle partitions that one holds ``rows_a_partition``
    of ``rows``: the number set for the session is raised, never lowered (AQE
    joins small ones again), and returned. Nothing here changes results."""
    name = "spark.sql.shuffle.partitions"
    n = max(int(spark.conf.get(name)), -(-rows // rows_a_partition))
    spark.conf.set(name, str(n))
    return n
