"""Reproducible draws. Order comes from md5 of id and seed, never from an engine's own hash or random state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def order_key(id_col: str, seed: str) -> Column:
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(seed)))


def ranked(df: DataFrame, id_col: str, seed: str, by: list[str]) -> DataFrame:
    """_rank within the stratum, and its size _n. A larger draw by the same seed holds every smaller one."""
    w = Window.partitionBy(*by)
    return df.withColumns({"_rank": F.row_number().over(w.orderBy(order_key(id_col, seed), id_col)), "_n": F.count("*").over(w)})


def draw(df: DataFrame, id_col: str, seed: str, by: list[str], n: int) -> DataFrame:
    """n rows of each stratum with stratum_n, pi and weight. Spark keeps only the n first rows of a stratum from
    each task before it deals them out, so a stratum with most of the rows is not sorted in one task."""
    size = df.groupBy(*by).agg(F.count("*").alias("stratum_n"))
    w = Window.partitionBy(*by).orderBy(order_key(id_col, seed), id_col)
    kept = df.select(*by, id_col).withColumn("draw", F.row_number().over(w)).where(F.col("draw") <= n).join(size, by)
    taken = F.least(F.col("stratum_n"), F.lit(n)).cast("double")
    return kept.select(*by, id_col, "draw", "stratum_n", (taken / F.col("stratum_n")).alias("pi"), (F.col("stratum_n") / taken).alias("weight"))


def chunks(df: DataFrame, id_col: str, seed: str, size: int) -> DataFrame:
    """A chunk number for each row, in hash order: ranks within cells of the hash, after the counts of the cells before."""
    keyed = df.withColumn("_cell", F.substring(order_key(id_col, seed), 1, 3))
    before = F.sum("_in").over(Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1))  # at most 4,096 cells
    cells = keyed.groupBy("_cell").agg(F.count("*").alias("_in")).select("_cell", F.coalesce(before, F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_cell").orderBy(order_key(id_col, seed), id_col)) - 1 + F.col("_before")
    return keyed.join(F.broadcast(cells), "_cell").withColumn("chunk", (F.floor(rank / size) + 1).cast("int")).drop("_cell", "_before")


def group_fold(group: Column, k: int) -> Column:
    """Fold of a group, so that a group is never split."""
    return F.pmod(F.conv(F.substring(F.md5(group), 1, 8), 16, 10).cast("long"), F.lit(k)).cast("int")


def dealt_counts(sizes: list[tuple[int, int]], k: int) -> dict[int, list[int]]:
    """How many groups of each size go to each of k folds if groups are dealt from the largest on, each to the fold with fewest rows, the first of equal ones.
    sizes: (rows, groups) of each size. A whole size is dealt at once: the folds take the smallest of load, load + rows, load + 2 rows, ..."""
    load, out = [0] * k, {}
    for rows, groups in sorted(sizes, reverse=True):
        taken = lambda level, rows=rows: [max(0, -(-(level - x) // rows)) for x in load]
        low, high = min(load), max(load) + rows * (groups + 1)
        while high - low > 1:  # the highest level that doesn't take more groups than there are
            mid = (low + high) // 2
            low, high = (mid, high) if sum(taken(mid)) <= groups else (low, mid)
        got = taken(low)
        for f in range(k):  # those that stand at the level itself
            if sum(got) < groups and load[f] + got[f] * rows == low:
                got[f] += 1
        out[rows] = got
        load = [x + n * rows for x, n in zip(load, got, strict=True)]
    return out


def balanced_folds(df: DataFrame, group: str, id_col: str, k: int) -> DataFrame:
    """df with a fold from 0 to k - 1: no group is split, and groups go from the largest on to the fold with fewest rows, so folds differ by at most the largest group. A row
    without a group (null or blank) is a group of its own. Only the sizes of groups come to the driver, one number for each size that occurs."""
    if k < 1:
        raise ValueError("at least one fold")
    own = F.when(F.trim(F.col(group)) != "", F.concat(F.lit("g"), F.col(group))).otherwise(F.concat(F.lit("i"), F.col(id_col).cast("string")))
    own = F.coalesce(own, F.concat(F.lit("i"), F.col(id_col).cast("string")), F.lit("i"))
    keyed = df.withColumn("_group", own)
    groups = keyed.groupBy("_group").agg(F.count("*").alias("_rows")).withColumn("_at", F.md5("_group")).withColumn("_cell", F.substring("_at", 1, 3))
    sizes = [(r["_rows"], r["n"]) for r in groups.groupBy("_rows").agg(F.count("*").alias("n")).collect()]
    ends = [(rows, [sum(got[: f + 1]) for f in range(k)]) for rows, got in dealt_counts(sizes, k).items()]
    table = df.sparkSession.createDataFrame(ends, "_rows long, _ends array<long>")
    # ranks among the groups of one size, by hash: within cells of the hash, after the counts of the cells before
    before = F.sum("_in").over(Window.partitionBy("_rows").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1))
    cells = groups.groupBy("_rows", "_cell").agg(F.count("*").alias("_in")).select("_rows", "_cell", F.coalesce(before, F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_rows", "_cell").orderBy("_at", "_group")) - 1 + F.col("_before")
    folds = groups.join(cells, ["_rows", "_cell"]).withColumn("_rank", rank).join(table, "_rows").select("_group", F.size(F.filter("_ends", lambda e: e <= F.col("_rank"))).alias("fold"))
    return keyed.join(folds, "_group").drop("_group")
