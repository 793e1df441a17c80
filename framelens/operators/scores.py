"""Ordered cumulative measures of scored rows: thresholds, precision, ranks and quotas.

Rows of equal score are one step: they are summed first, so the running totals pass over distinct scores.
Running totals go by ranges: each range is summed apart and the sums of the ranges before it are added, so no
window holds all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CELLS = 64


def steps(df: DataFrame, score: str, positive: Column, weight: Column, by: list[str] = ()) -> DataFrame:
    """A row for each distinct score with weights of positives (gp) and all (ga), and running tp and all (cum), by score from the top."""
    by = list(by)
    g = df.groupBy(*by, F.col(score).alias("score")).agg(F.sum(F.when(positive, weight).otherwise(0.0)).alias("gp"), F.sum(weight).alias("ga"))
    # cells between quantiles of the distinct scores, at most CELLS of them; the sums are named so that the aggregation is the same one as below and read once
    known = F.when(F.col("ga").isNotNull() | F.col("gp").isNotNull(), F.col("score"))
    cuts = g.agg(F.percentile_approx(known, [i / CELLS for i in range(1, CELLS)], 1000).alias("cuts"))
    g = g.join(F.broadcast(cuts)).withColumn("cell", F.size(F.filter("cuts", lambda c: F.col("score") <= c))).drop("cuts")
    whole = g.groupBy(*by, "cell").agg(F.sum("gp").alias("cp"), F.sum("ga").alias("ca"))
    over = Window.partitionBy(*by).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select(*by, "cell", F.coalesce(F.sum("cp").over(over), F.lit(0.0)).alias("bp"), F.coalesce(F.sum("ca").over(over), F.lit(0.0)).alias("ba"))
    w = Window.partitionBy(*by, "cell").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    return g.join(whole, [*by, "cell"]).select(*by, "score", "gp", "ga", (F.sum("gp").over(w) + F.col("bp")).alias("tp"), (F.sum("ga").over(w) + F.col("ba")).alias("cum"))


def f_beta(tp: Column, flagged: Column, positives: Column, beta: float) -> Column:
    b = beta * beta
    return F.coalesce(F.try_divide((1 + b) * tp, b * positives + flagged), F.lit(0.0))


def best_threshold(df: DataFrame, score: str, positive: Column, weight: Column, beta: float, low_tie: bool, by: list[str] = ()) -> DataFrame:
    """Threshold of largest weighted F-beta. low_tie: equal values (to 15 places) take the lower threshold and
    without positives the lowest score; else the higher one, and without positives one above all scores."""
    by = list(by)
    s = steps(df, score, positive, weight, by)
    total = s.groupBy(*by).agg(F.sum("gp").alias("p"), F.max("score").alias("top"), F.min("score").alias("low"))
    s = (s.join(total, by) if by else s.join(F.broadcast(total))).withColumn("f", F.round(f_beta(F.col("tp"), F.col("cum"), F.col("p"), beta), 15))
    order = F.struct("f", F.negate("score")) if low_tie else F.struct("f", "score")
    out = s.groupBy(*by).agg(F.max_by(F.struct("score", "f"), order).alias("b"), F.first("p").alias("p"), F.first("top").alias("top"), F.first("low").alias("low"))
    none = F.col("low") if low_tie else F.greatest(F.lit(1.0), F.col("top")) + 1e-9
    return out.select(*by, F.when(F.col("p") > 0, F.col("b.score")).otherwise(none).alias("threshold"), F.when(F.col("p") > 0, F.col("b.f")).otherwise(F.lit(0.0)).alias("f"))


def average_precision(df: DataFrame, score: str, positive: Column, weight: Column, by: list[str] = ()) -> DataFrame:
    by = list(by)
    s = steps(df, score, positive, weight, by)
    return s.groupBy(*by).agg(F.try_divide(F.sum(F.col("gp") * F.col("tp") / F.col("cum")), F.sum("gp")).alias("ap"))


def midrank_auc(df: DataFrame, score: str, positive: Column, weight: Column, by: list[str] = ()) -> DataFrame:
    """Half credit for ties."""
    by = list(by)
    s = steps(df, score, positive, weight, by).withColumn("gn", F.col("ga") - F.col("gp"))
    total = s.groupBy(*by).agg(F.sum("gp").alias("p"), F.sum("gn").alias("n"))
    s = s.join(total, by) if by else s.join(F.broadcast(total))
    below = F.col("n") - (F.col("cum") - F.col("tp"))
    return s.groupBy(*by).agg(F.try_divide(F.sum(F.col("gp") * (below + 0.5 * F.col("gn"))), F.first("p") * F.first("n")).alias("auc"))


def confusion(label: Column, decision: Column, weight: Column) -> list[Column]:
    part = lambda c, n: F.coalesce(F.sum(F.when(c, weight)), F.lit(0.0)).alias(n)
    return [part(label & decision, "tp"), part(~label & decision, "fp"), part(label & ~decision, "fn"), part(~label & ~decision, "tn")]


def quota_flags(df: DataFrame, score: str, id_col: str, rate: float, by: list[str]) -> DataFrame:
    """flag: among the first bround(rate * n) rows of the group by score, then id. Groups are whole heads, so the
    boundary row is found on the steps of distinct scores, whose totals go by ranges, not by sorting a head in one task."""
    return first_rows(df, score, id_col, lambda n: F.bround(n * F.lit(rate)), by)


def first_rows(df: DataFrame, score: str, id_col: str, many, by: list[str]) -> DataFrame:
    """flag: among the first rows of the group by score, then id; many: a function from the Column of the group's rows to how many."""
    s = steps(df, score, F.lit(True), F.lit(1.0), by)
    n = s.groupBy(*by).agg(many(F.max("cum").cast("long")).cast("long").alias("k"))
    at = s.join(n, by).where((F.col("cum") >= F.col("k")) & (F.col("cum") - F.col("ga") < F.col("k")))
    at = at.select(*by, F.col("score").alias("threshold"), (F.col("k") - (F.col("cum") - F.col("ga"))).cast("long").alias("need"))
    tied = df.join(at, by).where(F.col(score) == F.col("threshold"))
    edge = tied.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(id_col))).where("_r = need").select(*by, "threshold", F.col(id_col).alias("boundary"))
    return df.join(edge, by, "left").withColumn("flag", F.coalesce((F.col(score) > F.col("threshold")) | ((F.col(score) == F.col("threshold")) & (F.col(id_col) <= F.col("boundary"))), F.lit(False)))
