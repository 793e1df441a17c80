"""What the operators of this subpackage share: the shared folder, written tables, private column names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType

#: A null id is worked on as this id, smaller than any other, and given back as null.
NULL_ID = -(2**63)

#: Most rows and bytes that an explicitly broadcast side may have.
BROADCAST_ROWS, BROADCAST_BYTES = 2_000_000, 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where driver and executors are one process
    (tests) may it be unset; it is a local one then."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        sc = spark.sparkContext
        base = sc.getCheckpointDir()
        if not base:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="framelens-"))
            base = sc.getCheckpointDir()
    return f"{base.rstrip('/')}/framelens-{spark.sparkContext.applicationId}"


#: Paths that scratch() has given out in this process, and that weren't removed.
_PATHS: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets. Remove the application's folder when its work is over."""
    _PATHS.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}")
    return _PATHS[-1]


def paths() -> list[str]:
    return list(_PATHS)


def remove(spark: SparkSession, some: list[str]) -> None:
    """Removes tables that nothing reads any more."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in some:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
        _PATHS.remove(path)


def written(df: DataFrame, name: str, partition_by: list[str] | None = None, codec: str = "zstd") -> DataFrame:
    """df as a Parquet table in the shared folder: it cuts the lineage and outlives any executor."""
    spark = df.sparkSession
    path = scratch(spark, name)
    w = df.write.option("compression", codec)
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes after which Spark hands a batch of rows to Python. Spark's own 64 MB are held by the JVM outside its heap and again by the Python worker, for
#: each Python step of each task that runs.
ARROW_BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "1m")


def small_batches(spark: SparkSession) -> None:
    """Batches of ARROW_BATCH for this session, unless it has a setting of its own. It holds on, as Spark reads it when a query runs."""
    key, size = ARROW_BATCH
    if spark.conf.get(key, "1b") == "1b":
        spark.conf.set(key, size)


def keyed(col: str = "doc_id") -> Column:
    return F.coalesce(F.col(col).cast("long"), F.lit(NULL_ID))


def unkeyed(col: str) -> Column:
    return F.when(F.col(col) != F.lit(NULL_ID), F.col(col))


def _width(c: Column, kind: DataType) -> Column:
    """Bytes of a value, about: 16 for it and its place in a row, and what it holds."""
    if isinstance(kind, (StringType, BinaryType)):
        own = F.octet_length(c)
    elif isinstance(kind, StructType):
        own = sum((_width(c[f.name], f.dataType) for f in kind.fields), F.lit(0))
    elif isinstance(kind, ArrayType):
        own = F.aggregate(c, F.lit(0), lambda s, x: s + _width(x, kind.elementType).cast("int"))
    elif isinstance(kind, MapType):
        own = 64 * F.size(c)
    else:
        own = F.lit(0)
    return 16 + F.coalesce(own, F.lit(0))


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """True if df, a written table, has at most so many rows and bytes: only then may it be broadcast."""
    if df.limit(rows + 1).count() > rows:
        return False
    width = sum((_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(16))
    return (df.agg(F.sum(width.cast("long"))).first()[0] or 0) <= size


def join_small(big: DataFrame, small: DataFrame, on, how: str, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join that broadcasts the written table `small` behind a check of its size and shuffles beyond it."""
    return big.join(F.broadcast(small) if small_enough(small, rows) else small, on, how)


def bound(value: str, body: str, var: str) -> str:
    """SQL text that evaluates `value` once per row and `body` with it as `var`."""
    return f"transform(array({value}), {var} -> {body})[0]"
