"""Tables written in each published form and read back by the source for it."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelens.functions import text as T
from framelens.session import table
from framelens.sources import files
from framelens.sources.workspace import scratch


def _orders(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.round("o_totalprice", 2).alias("o_totalprice"))


def hive_partitions(spark, d):
    """Orders in a folder for each status, read up to a status."""
    path = scratch(spark, "hive")
    _orders(spark, d).write.partitionBy("o_orderstatus").parquet(path)
    return files.partitioned(spark, path, "o_orderstatus", "O").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 1).alias("total"))


def recursive_parquet(spark, d):
    """Folders within folders, of any names, read as one table; files of other kinds are passed over."""
    path, o = scratch(spark, "deep"), _orders(spark, d)
    for k, folder in enumerate(("a", "a/b/c", "z")):
        files.to_parquet(o.where(F.col("o_orderkey") % 3 == k), f"{path}/{folder}/part")
    o.limit(3).select(F.col("o_orderstatus")).write.text(f"{path}/z/notes")
    return files.recursive(spark, path, o.schema).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"))


def csv_lines(spark, d):
    """Lines with a header of which some don't fit the schema: those read and those refused."""
    path = scratch(spark, "csv")
    key = F.when(F.col("c_custkey") % 10 == 3, F.lit("oops")).otherwise(F.col("c_custkey").cast("string"))
    files.to_csv(table(spark, d, "customer").select(key.alias("c_custkey"), "c_name", "c_mktsegment"), path)
    schema = "c_custkey long, c_name string, c_mktsegment string"
    read = files.csv(spark, path, schema).groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.sum("c_custkey").alias("keys"))
    bad = files.refused_csv(spark, path, schema).groupBy("c_mktsegment").agg(F.count("line").alias("refused"))
    return read.join(bad, "c_mktsegment", "full_outer").select("c_mktsegment", "n", "keys", F.coalesce("refused", F.lit(0)).alias("refused"))


def json_files(spark, d):
    """Files that each hold an array of records, some of them in two files: each record once."""
    path = scratch(spark, "arrays")
    n = table(spark, d, "customer").select(F.explode(F.when(F.col("c_custkey") % 4 == 0, F.array(F.col("c_nationkey"), F.lit(99))).otherwise(F.array("c_nationkey"))).alias("file"), F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), "c_nationkey").alias("r"))
    n.groupBy("file").agg(F.to_json(F.sort_array(F.collect_list("r"))).alias("value")).repartition(8, "file").write.partitionBy("file").text(path)
    got = files.json_arrays(spark, f"{path}/*/*", "id long, name string, c_nationkey int", "id")
    return got.groupBy("c_nationkey").agg(F.count("*").alias("n"), F.min("name").alias("first"))


def gzip_arrays(spark, d):
    """Lists as array literals in compressed lines, read back."""
    path = scratch(spark, "gz")
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_returnflag")).alias("f"))
    files.to_csv(li.select("l_orderkey", T.pg_array(F.col("f")).alias("flags")), path, "gzip")
    back = spark.read.schema("l_orderkey long, flags string").options(header=True, escape="\\").csv(path)
    return back.groupBy("flags").agg(F.count("*").alias("orders"), F.sum("l_orderkey").alias("keys"))


def ordered_files(spark, d):
    """Orders written in order of price over all files: rows, and files whose rows begin before those of the file before end."""
    from pyspark.sql.window import Window

    path = scratch(spark, "ordered")
    files.to_parquet(_orders(spark, d), path, ["o_totalprice", "o_orderkey"])
    at = F.struct("o_totalprice", "o_orderkey")
    bounds = spark.read.parquet(path).groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("n"), F.min(at).alias("low"), F.max(at).alias("high"))
    late = bounds.select("n", (F.col("low") <= F.lag("high").over(Window.orderBy("file"))).alias("late"))  # a row a file
    return late.agg(F.sum("n").alias("rows"), F.count_if("late").alias("late"))


def venue_keys(spark, d):
    """Names of venues that differ in case and white space are one; rows without a name are venues of their own."""
    p = table(spark, d, "part")
    v = F.when(F.col("p_partkey") % 9 == 0, None).when(F.col("p_partkey") % 9 == 1, " \t").when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("  "), F.upper("p_brand"), F.lit(" "))).otherwise(F.lower("p_brand"))
    key = T.venue_key(F.regexp_replace(v, "#", "  #  "), F.col("p_partkey"))
    return p.groupBy(key.alias("venue")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"))


QUERIES = {f.__name__: f for f in (hive_partitions, recursive_parquet, csv_lines, json_files, gzip_arrays, ordered_files, venue_keys)}
ORACLE = {
    "hive_partitions": "SELECT o_orderstatus, count(*) AS n, round(sum(round(o_totalprice, 2)), 1) AS total FROM orders WHERE o_orderstatus <= 'O' GROUP BY 1",
    "recursive_parquet": "SELECT o_orderstatus, count(*) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last FROM orders GROUP BY 1",
    "csv_lines": "SELECT c_mktsegment, nullif(count(*) FILTER (WHERE c_custkey % 10 <> 3), 0) AS n, CAST(sum(c_custkey) FILTER (WHERE c_custkey % 10 <> 3) AS BIGINT) AS keys, count(*) FILTER (WHERE c_custkey % 10 = 3) AS refused FROM customer GROUP BY 1",
    "json_files": "SELECT c_nationkey, count(*) AS n, min(c_name) AS first FROM customer GROUP BY 1",
    "gzip_arrays": "SELECT flags, count(*) AS orders, CAST(sum(l_orderkey) AS BIGINT) AS keys FROM (SELECT l_orderkey, '{' || string_agg(DISTINCT '\"' || l_returnflag || '\"', ',' ORDER BY '\"' || l_returnflag || '\"') || '}' AS flags FROM lineitem GROUP BY 1) GROUP BY 1",
    "ordered_files": "SELECT count(*) AS rows, CAST(0 AS BIGINT) AS late FROM orders",
    "venue_keys": "SELECT CASE WHEN p_partkey % 9 < 2 THEN '__missing__:' || p_partkey ELSE replace(lower(p_brand), '#', ' # ') END AS venue, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY 1",
}
