"""Substring search by a trigram table, and prefix search in facets, in files that let a scan skip most of them.

Postings (gram, key) and facets (folded, value, n) are written in order over all files with a Bloom filter on what is looked up, so a lookup reads the row
groups whose bounds and filter admit it. Candidates are then joined with the table and tested by `ilike` itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Grams that a search looks up: the rarest of the pattern.
LOOKED_UP = 3


def grams(text: Column) -> Column:
    """The distinct windows of three characters, in lower case; null and shorter texts have none."""

    def of(t: Column) -> Column:
        return F.when(F.char_length(t) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(t) - 2), lambda i: F.substring(t, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))

    return F.transform(F.array(F.lower(F.coalesce(text, F.lit("")))), of)[0]


def _sorted_files(df: DataFrame, path: str, column: str, order: list[str], files: int, group_bytes: int) -> None:
    dealt = df.repartitionByRange(files, *order).sortWithinPartitions(*order)
    dealt.write.option("compression", "zstd").option(f"parquet.bloom.filter.enabled#{column}", "true").option("parquet.block.size", str(group_bytes)).parquet(path)


def write_postings(df: DataFrame, key: str, text: str, path: str, files: int = 64, group_bytes: int = 8 << 20) -> None:
    """Under path: `postings` (gram, key), a frequent gram over several files, and `counts` (gram, n)."""
    rows = df.select(F.explode(grams(F.col(text))).alias("gram"), F.col(key).alias("key"))
    _sorted_files(rows, f"{path}/postings", "gram", ["gram", "key"], files, group_bytes)
    _sorted_files(df.sparkSession.read.parquet(f"{path}/postings").groupBy("gram").agg(F.count("*").alias("n")), f"{path}/counts", "gram", ["gram"], max(1, files // 16), group_bytes)


def literal_runs(pattern: str) -> list[str]:
    """The runs of a LIKE pattern between its wildcards, unescaped."""
    runs, run, at = [], [], 0
    while at < len(pattern):
        c = pattern[at]
        if c in "%_":
            runs.append("".join(run))
            run = []
        else:
            if c == "\\" and at + 1 < len(pattern):
                at += 1
            run.append(pattern[at])
        at += 1
    return [r for r in [*runs, "".join(run)] if r]


def candidates(spark, path: str, pattern: str) -> DataFrame | None:
    """Keys of the rows that hold the rarest grams of a pattern; None if it has no run of three characters."""
    lowered = [spark.range(1).select(F.lower(F.lit(r))).first()[0] for r in literal_runs(pattern)]
    wanted = sorted({r[i : i + 3] for r in lowered for i in range(len(r) - 2)})
    if not wanted:
        return None
    known = {r["gram"]: r["n"] for r in spark.read.parquet(f"{path}/counts").where(F.col("gram").isin(wanted)).collect()}
    rare = sorted(wanted, key=lambda g: (known.get(g, 0), g))[:LOOKED_UP]
    found = spark.read.parquet(f"{path}/postings").where(F.col("gram").isin(rare))
    return found.groupBy("key").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(rare)).select("key")


def search(df: DataFrame, key: str, text: str, path: str, pattern: str) -> DataFrame:
    """The rows of df whose text is `ilike` the pattern, found by the postings written under path; a pattern without three literal characters in a row is a
    scan of df."""
    some = candidates(df.sparkSession, path, pattern)
    near = df if some is None else df.join(some.withColumnRenamed("key", key), key, "left_semi").select(*df.columns)
    return near.where(F.col(text).ilike(pattern))


def write_facets(df: DataFrame, column: str, path: str, files: int = 8, group_bytes: int = 8 << 20) -> None:
    """Under path: the values of a column but null and empty ones, their lower case and how often they occur."""
    g = df.where(F.col(column).isNotNull() & (F.col(column) != "")).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    _sorted_files(g.select(F.lower("value").alias("folded"), "value", "n"), path, "folded", ["folded", "value"], files, group_bytes)


def facets_like(spark, path: str, prefix: str, k: int) -> DataFrame:
    """The k most frequent values that begin so, in any case."""
    start = spark.range(1).select(F.lower(F.lit(prefix))).first()[0]
    return spark.read.parquet(path).where(F.col("folded").startswith(start)).orderBy(F.desc("n"), "value").limit(k).select("value", "n")


def scanned(df: DataFrame) -> dict[str, int]:
    """Files and rows that the scans of an executed DataFrame have read."""
    out = {"numFiles": 0, "numOutputRows": 0}
    todo = [df._jdf.queryExecution().executedPlan()]
    while todo:
        plan = todo.pop()
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(plan.executedPlan())
            continue
        if name.endswith("QueryStageExec"):
            todo.append(plan.plan())
            continue
        if name == "FileSourceScanExec":
            metrics = plan.metrics()
            for k in out:
                out[k] += metrics.apply(k).value()
        children = plan.children()
        todo += [children.apply(i) for i in range(children.size())]
    return out
