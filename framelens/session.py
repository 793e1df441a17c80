"""Session settings used by the tests, the bench and interactive work.

On a cluster the session is made by the submitter; nothing in the library
overrides a setting that is already there.
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "framelens", master: str | None = None, cpus: int | None = None, **conf: str) -> SparkSession:
    """Local session with adaptive execution on, UTC and ANSI mode (Spark's default) left on."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "0")) or os.cpu_count() or 4
    b = (
        SparkSession.builder.master(master or f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("FRAMELENS_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the Parquet tables of a data folder, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
