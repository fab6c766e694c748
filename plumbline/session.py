"""Session defaults and lineage cutting."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings every plan here relies on. They only affect SQL planning, so they can be
# applied to a session that somebody else created.
PLAN_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join input even when that costs one more exchange afterwards.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Batches sent to Python hold whole texts: fewer rows keep both sides of the exchange small.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}

#: Compression of tables that are written for later steps: half the disk of the default.
PACKED = "zstd"


def tune(spark: SparkSession) -> SparkSession:
    """Apply the planning defaults to a running session."""
    for key, value in PLAN_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = 8, name: str = "plumbline") -> SparkSession:
    """A local session for tests and benchmarks."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", "12g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="plumbline-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # Call-site capture costs several JVM round trips per column function (static setting).
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the area named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder; on a cluster a missing setting is an error,
    because executors can be lost.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        base = tempfile.mkdtemp(prefix="plumbline-")
    return f"{base.rstrip('/')}/plumbline-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back, which cuts its lineage.

    Unlike an RDD checkpoint the plan runs once, and readers still prune columns and know the size.
    """
    folder = shared_folder(df.sparkSession)
    df.write.option("compression", PACKED).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
