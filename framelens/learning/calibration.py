"""Sigmoid calibration of scores by Newton steps over sums that Spark makes, for any number of groups at once."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Step lengths that are tried at once, and the least gain in the loss that counts.
LENGTHS = [1.0, 0.5, 0.25, 0.125, 0.03125, 0.0078125]
RIDGE, GRADIENT = 1e-12, 1e-7


def _terms(a, b):
    """Loss and 1 - probability for logit -(a s + b), without overflow."""
    z = a * F.col("score") + b
    loss = F.col("t") * z + F.log1p(F.exp(-F.abs(z))) + F.greatest(-z, F.lit(0.0))
    p = F.when(z >= 0, F.exp(-z) / (1 + F.exp(-z))).otherwise(1 / (1 + F.exp(z)))
    return loss, p


def fit_sigmoid(scores: DataFrame, by: str, rounds: int = 50) -> dict:
    """(a, b) of each group, so that 1 / (1 + exp(a score + b)) is the probability of label 1. scores, a written table: by, score (a margin), label
    (0 or 1; null is left out). Labels are smoothed by the counts of both, so that separable scores have a finite fit. Each step is one pass, for the
    losses of all lengths and the gradients there, of which the next step needs one; only sums come to the driver, some numbers for each group."""
    rows = scores.where("label IS NOT NULL AND score IS NOT NULL").select(F.col(by).alias("g"), F.col("score").cast("double"), F.col("label").cast("double").alias("y"))
    n = {r["g"]: (r["n1"], r["n0"]) for r in rows.groupBy("g").agg(F.sum("y").alias("n1"), F.sum(1 - F.col("y")).alias("n0")).collect()}
    spark = scores.sparkSession
    now = {g: (0.0, math.log((n0 + 1) / (n1 + 1))) for g, (n1, n0) in n.items()}
    kind = rows.schema["g"].dataType.simpleString()

    def table(values: dict, names: str) -> DataFrame:
        return F.broadcast(spark.createDataFrame([(g, *map(float, v)) for g, v in values.items()], f"g {kind}, {names}"))

    smooth = {g: ((n1 + 1) / (n1 + 2), 1 / (n0 + 2)) for g, (n1, n0) in n.items()}
    if not n:
        return {}
    aimed = rows.join(table(smooth, "high double, low double"), "g").withColumn("t", F.when(F.col("y") > 0, F.col("high")).otherwise(F.col("low")))

    def sums(tried: dict) -> dict:
        """Loss, gradient and second derivatives at each of the (a, b) of each group, by group and number, in one pass."""
        at = spark.createDataFrame([(g, i, float(a), float(b)) for g, each in tried.items() for i, (a, b) in enumerate(each)], f"g {kind}, i int, a double, b double")
        loss, p = _terms(F.col("a"), F.col("b"))
        d, h, s = F.col("t") - p, p * (1 - p), F.col("score")
        each = aimed.join(F.broadcast(at), "g").groupBy("g", "i").agg(F.sum(loss).alias("loss"), F.sum(s * d).alias("g1"), F.sum(d).alias("g2"), F.sum(s * s * h).alias("h11"), F.sum(h).alias("h22"), F.sum(s * h).alias("h21"))
        return {(r["g"], r["i"]): r for r in each.collect()}

    found = sums({g: [x] for g, x in now.items()})
    here = {g: found[g, 0] for g in now if (g, 0) in found}
    for _ in range(rounds):
        tried, slope = {}, {}
        for g, r in here.items():
            if abs(r["g1"]) < GRADIENT and abs(r["g2"]) < GRADIENT:
                continue
            h11, h22 = r["h11"] + RIDGE, r["h22"] + RIDGE
            det = h11 * h22 - r["h21"] ** 2
            da, db = -(h22 * r["g1"] - r["h21"] * r["g2"]) / det, -(h11 * r["g2"] - r["h21"] * r["g1"]) / det
            a, b = now[g]
            tried[g] = [(a + k * da, b + k * db) for k in LENGTHS]
            slope[g] = r["g1"] * da + r["g2"] * db
        if not tried:
            break
        found, before, here = sums(tried), here, {}
        for g, each in tried.items():
            good = [i for i, k in enumerate(LENGTHS) if found[g, i]["loss"] < before[g]["loss"] + 1e-4 * k * slope[g]]
            if good:  # else it is as good as sums can tell
                now[g], here[g] = each[good[0]], found[g, good[0]]
    return now


def calibrated(scores: DataFrame, by: str, fits: dict) -> DataFrame:
    """scores with `probability`; a group without a fit has none."""
    kind = scores.schema[by].dataType.simpleString()
    table = scores.sparkSession.createDataFrame([(g, a, b) for g, (a, b) in fits.items()], f"{by} {kind}, _a double, _b double")
    z = F.col("_a") * F.col("score") + F.col("_b")
    p = F.when(z >= 0, F.exp(-z) / (1 + F.exp(-z))).otherwise(1 / (1 + F.exp(z)))
    return scores.join(F.broadcast(table), by, "left").withColumn("probability", p).drop("_a", "_b")


def calibrated_oof(rows: DataFrame, size: int, folds: int, path: str, inner: int = 3, least: int = 10, id_col: str = "id", **sgd) -> DataFrame:
    """id, fold, label, plain and probability: scores by models that never saw the row's fold. rows, a written table: id, vector, label (0 or 1), fold (0 to folds - 1),
    part (0 to inner - 1, for calibration). path: a folder for the margins.

    For each fold `inner` models are trained on the other folds without one part, calibrated on that part, and their probabilities of the fold's rows
    are averaged. `plain` is the score of a model trained on all other folds; where the other folds have fewer than `least` positives,
    probability is plain. All models are trained in one run."""
    from framelens.learning import linear

    base = [(f, None) for f in range(folds)] + [(f, k) for f in range(folds) for k in range(inner)]
    at = {m: i for i, m in enumerate(base)}
    own = [(at[f, k], F.when((F.col("fold") != f) & (F.lit(True) if k is None else F.col("part") != k), F.col("label")), 1.0) for f, k in base]
    ready, _ = linear.balanced(rows.select(id_col, "vector", linear.tasks(*own).alias("tasks")))
    models = linear.fit_sgd(ready, len(base), size, id_col, **sgd)
    # a row is scored by the models of its own fold and by those that left out its part, for their calibration
    which = F.array_compact(F.array(*[F.when((F.col("fold") == f) | (F.lit(k is not None) & (F.col("part") == F.lit(k))), F.lit(i)) for (f, k), i in at.items()]))
    margins = linear.scored(rows.select(id_col, "vector", which.alias("_w")), models, id_col, F.col("_w"), margin=True)
    spark = rows.sparkSession
    names = spark.createDataFrame([(i, f, k) for (f, k), i in at.items()], "model int, of_fold int, of_part int")
    # joined before they are written: the fit reads them in every step
    margins.join(F.broadcast(names), "model").join(rows.select(id_col, "fold", "part", "label"), id_col).write.option("compression", "zstd").parquet(path)
    all_ = spark.read.parquet(path)
    fits = fit_sigmoid(all_.where("of_part = part AND of_fold <> fold").select("model", "score", "label"), "model")
    held = calibrated(all_.where("of_fold = fold"), "model", fits)
    positives = rows.groupBy("fold").agg(F.sum("label").alias("own"))
    positives = positives.join(positives.agg(F.sum("own").alias("all"))).select("fold", (F.col("all") - F.col("own")).alias("_positives"))
    g = held.groupBy(id_col, "fold", "label").agg(F.max(F.when(F.col("of_part").isNull(), 1 / (1 + F.exp(-F.col("score"))))).alias("plain"), F.avg(F.when(F.col("of_part").isNotNull(), F.col("probability"))).alias("mean"))
    return g.join(F.broadcast(positives), "fold").select(id_col, "fold", "label", "plain", F.when(F.col("_positives") >= least, F.col("mean")).otherwise(F.col("plain")).alias("probability"))
