"""Tables that cut a lineage: in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where driver and executors are one process it may be unset and is a temporary folder then."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="framelens-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/framelens-{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, name: str) -> str:
    """A path that no other call gets."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def filesystem(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path in its terms: whatever store Spark reads."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def removed(spark: SparkSession, path: str) -> None:
    fs, p = filesystem(spark, path)
    fs.delete(p, True)


def small_batches(spark: SparkSession) -> None:
    """Batches of 1 MB between Spark and Python for this session, unless it has a setting of its own. Spark's own 64 MB are held outside the heap of an
    executor and again by its Python, for each Python step of each task that runs."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, "1b") == "1b":  # unset
        spark.conf.set(key, "1m")


def written(df: DataFrame, path: str, **options) -> DataFrame:
    df.write.options(**{"compression": "zstd"} | options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
