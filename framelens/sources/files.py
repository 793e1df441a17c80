"""File sources and sinks with explicit schemas. Paths go to Spark as they are, so any store that it reads will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from framelens.operators.contracts import inventory


def partitioned(spark: SparkSession, root: str, column: str, cutoff: str) -> DataFrame:
    """A tree of column=value folders up to a cutoff; folders beyond it aren't read."""
    return spark.read.parquet(root).where(F.col(column) <= cutoff)


def recursive(spark: SparkSession, root: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(root)


def _all_read(df: DataFrame) -> DataFrame:
    """df with a condition that holds for every row and needs every column: Spark would otherwise check only the columns that a query uses."""
    return df.where(F.xxhash64(*[f"`{c}`" for c in df.columns]) >= F.lit(-(2**63)))


def csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """With a header; rows that don't fit the schema are dropped, whichever columns are read. refused_csv gives them."""
    return _all_read(spark.read.schema(schema).options(header=True, mode="DROPMALFORMED").csv(path))


def refused_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows that csv drops: what could be read of them, the line and its file."""
    rows = spark.read.schema(f"{schema}, line string").options(header=True, mode="PERMISSIVE", columnNameOfCorruptRecord="line").csv(path)
    rows = _all_read(rows)
    return rows.select("*", F.col("_metadata.file_name").alias("file")).where("line IS NOT NULL")


def json_arrays(spark: SparkSession, path: str, schema: StructType | str, id_col: str, keep: str = "last") -> DataFrame:
    """Files that each hold a JSON array; of rows with one id the first or last by file name and then by content stays."""
    rows = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("_file", F.input_file_name())
    names = [c for c in rows.columns if c != "_file"]
    pick = F.max_by if keep == "last" else F.min_by
    row = F.struct(*names)
    return rows.groupBy(F.col(id_col).alias("_k")).agg(pick(row, F.struct("_file", F.to_json(row))).alias("r")).select("r.*")


def xml(spark: SparkSession, path: str, tag: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).format("xml").option("rowTag", tag).load(path)


def to_parquet(df: DataFrame, path: str, order_by: list[str] | None = None, mode: str = "errorifexists") -> None:
    """zstd; ordered by ranges over all files if asked. Spark's commit protocol makes it all or nothing."""
    (df.orderBy(*order_by) if order_by else df).write.mode(mode).option("compression", "zstd").parquet(path)


def to_csv(df: DataFrame, path: str, compression: str | None = None, mode: str = "errorifexists") -> None:
    w = df.write.mode(mode).option("header", True)
    (w.option("compression", compression) if compression else w).csv(path)


def missing_parts(listed: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return listed.select(key).distinct().join(done.select(key), key, "left_anti")


def write_parts(df: DataFrame, path: str, part: str, id_col: str) -> DataFrame:
    """df under path, a folder for each part, and its inventory under path-inventory. Returns the inventory."""
    df.write.partitionBy(part).option("compression", "zstd").parquet(path)
    inventory(df, part, id_col).write.parquet(f"{path}-inventory")
    return df.sparkSession.read.parquet(f"{path}-inventory")


def merged_parts(spark: SparkSession, path: str, part: str, id_col: str) -> DataFrame:
    """The parts under path in order of part and id. Refused where a part isn't what the inventory says."""
    df = spark.read.parquet(path)
    said = spark.read.parquet(f"{path}-inventory")
    have = inventory(df, part, id_col)
    wrong = said.exceptAll(have.select(*said.columns)).select(part).union(have.select(*said.columns).exceptAll(said).select(part)).distinct().limit(5).collect()
    if wrong:
        raise ValueError(f"parts differ from their inventory: {sorted(str(r[0]) for r in wrong)}")
    return df.orderBy(part, id_col)
