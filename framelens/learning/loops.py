"""Loops of rounds whose state is a table: active learning against a random control, and self-training.

A round is written as one folder of rows and one of figures before the next begins. Everything a round decides follows from the folders before it
and from md5 digests of ids, so a driver that takes over goes on where the last one stopped and takes the same batches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelens.learning import linear
from framelens.operators import scores as S
from framelens.sources.workspace import filesystem


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = filesystem(spark, f"{path}/_SUCCESS")
    return fs.exists(p)


def _order(id_col: str, seed: str) -> list[Column]:
    return [F.md5(F.concat(F.col(id_col).cast("string"), F.lit(seed))), F.col(id_col)]


def _first(df: DataFrame, id_col: str, order: list[Column], n: int, role: str, arm: str) -> DataFrame:
    return df.orderBy(*order).limit(n).select(id_col, F.lit(role).alias("role"), F.lit(arm).alias("arm"))


@dataclass(frozen=True)
class Plan:
    """What a round takes: the rows that the teachers' heads disagree on most, the least sure ones, and anchors drawn by hash; and when to stop: `rounds`, a pool
    smaller than a batch, or three rounds in a row whose churn and change in average precision on the holdout are at most `churn` and `gain`."""

    rounds: int = 20
    disagree: int = 40
    uncertain: int = 40
    anchors: int = 20
    holdout: float = 0.25
    churn: float = 0.02
    gain: float = 0.002
    seed: str = "a"

    @property
    def batch(self) -> int:
        return self.disagree + self.uncertain + self.anchors


def active_loop(rows: DataFrame, teachers: list[str], truth: str, size: int, path: str, plan: Plan = Plan(), id_col: str = "id", **sgd) -> DataFrame:
    """The figures of the rounds, from rows (a written table): id, vector, weight, a column of 0, 1 or null for each teacher, and one for `truth`.

    The holdout is drawn once by hash and never revealed, so that precision and churn are of the same rows in all rounds. Each round trains a head for each teacher
    on the revealed rows, and a control on as many rows drawn at random. The spread of the heads and the closeness of their mean to a half choose the next batch.

    round, n_revealed, n_anchors, anchor_positives, anchor_rate, anchor_se (weighted, by the effective size), holdout_ap, control_ap, churn, mean_spread, stopped."""
    spark = rows.sparkSession
    if not _exists(spark, f"{path}/holdout"):
        bound = F.lit(int(plan.holdout * 16**7))
        held = rows.where(F.conv(F.substring(F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"{plan.seed}-holdout"))), 1, 7), 16, 10).cast("long") < bound)
        held.select(id_col).write.mode("overwrite").parquet(f"{path}/holdout")
    holdout = spark.read.parquet(f"{path}/holdout")
    free = rows.join(holdout, id_col, "left_anti").select(id_col)
    if not _exists(spark, f"{path}/taken/round=0"):
        seed = _first(free, id_col, _order(id_col, f"{plan.seed}-seed"), plan.batch, "seed", "active").unionByName(_first(free, id_col, _order(id_col, f"{plan.seed}-control-0"), plan.batch, "seed", "control"))
        seed.write.mode("overwrite").parquet(f"{path}/taken/round=0")
    heads = len(teachers)
    for k in range(1, plan.rounds + 1):
        if _exists(spark, f"{path}/figures/round={k}"):
            if spark.read.parquet(f"{path}/figures/round={k}").first()["stopped"] is not None:
                break
            continue
        taken = spark.read.parquet(*[f"{path}/taken/round={j}" for j in range(k)])
        active, control = (taken.where(F.col("arm") == arm).select(id_col, F.col("role").alias(f"_{arm}")) for arm in ("active", "control"))
        known = rows.join(active, id_col, "left").join(control, id_col, "left")
        mine, other = F.col("_active").isNotNull(), F.col("_control").isNotNull()
        own = [(i, F.when(mine, F.col(t)), 1.0) for i, t in enumerate(teachers)] + [(heads, F.when(other, F.col(truth)), 1.0)]
        ready, _ = linear.balanced(known.select(id_col, "vector", linear.tasks(*own).alias("tasks")).where(F.size("tasks") > 0))
        models = linear.fit_sgd(ready, heads + 1, size, id_col, **sgd)
        cells = linear.scored(rows.select(id_col, "vector"), models, id_col).groupBy(id_col).agg(
            F.max(F.when(F.col("model") < heads, F.col("score"))).alias("_hi"), F.min(F.when(F.col("model") < heads, F.col("score"))).alias("_lo"),
            F.avg(F.when(F.col("model") < heads, F.col("score"))).alias("mean"), F.max(F.when(F.col("model") == heads, F.col("score"))).alias("control"),
        )
        cells.select(id_col, (F.col("_hi") - F.col("_lo")).alias("spread"), "mean", "control").write.mode("overwrite").parquet(f"{path}/scores/round={k}")
        scores = spark.read.parquet(f"{path}/scores/round={k}")

        # the next batches
        pool = scores.join(free, id_col, "left_semi").join(active, id_col, "left_anti")
        size_left = pool.limit(plan.batch).count()
        if size_left == plan.batch:
            spread = _first(pool, id_col, [F.desc("spread"), F.col(id_col)], plan.disagree, "disagree", "active")
            rest = pool.join(spread, id_col, "left_anti")
            unsure = _first(rest, id_col, [F.abs(F.col("mean") - 0.5), F.col(id_col)], plan.uncertain, "uncertain", "active")
            rest = rest.join(unsure, id_col, "left_anti")
            anchor = _first(rest, id_col, _order(id_col, f"{plan.seed}-{k}"), plan.anchors, "anchor", "active")
            lot = _first(free.join(control, id_col, "left_anti"), id_col, _order(id_col, f"{plan.seed}-control-{k}"), plan.batch, "control", "control")
            spread.unionByName(unsure).unionByName(anchor).unionByName(lot).write.mode("overwrite").parquet(f"{path}/taken/round={k}")

        figures = _figures(rows, scores, holdout, known, truth, id_col, path, k)
        last = [spark.read.parquet(f"{path}/figures/round={j}").first() for j in range(max(1, k - 2), k)]
        last.append(figures)
        still = len(last) == 3 and all(r["churn"] <= plan.churn for r in last) and max(r["holdout_ap"] or 0 for r in last) - min(r["holdout_ap"] or 0 for r in last) <= plan.gain
        stopped = "pool" if size_left < plan.batch else "still" if still else "rounds" if k == plan.rounds else None
        kept = {**figures, "round": k, "stopped": stopped}
        spark.createDataFrame([tuple(kept[c] for c in _NAMES)], _SCHEMA).write.mode("overwrite").parquet(f"{path}/figures/round={k}")
        if stopped:
            break
    done = [j for j in range(1, plan.rounds + 1) if _exists(spark, f"{path}/figures/round={j}")]
    return spark.read.schema(_SCHEMA).parquet(*[f"{path}/figures/round={j}" for j in done]) if done else spark.createDataFrame([], _SCHEMA)


_SCHEMA = "round int, n_revealed long, n_anchors long, anchor_positives long, anchor_rate double, anchor_se double, holdout_ap double, control_ap double, churn double, mean_spread double, stopped string"
_NAMES = [x.split()[0] for x in _SCHEMA.split(", ")]


def _figures(rows: DataFrame, scores: DataFrame, holdout: DataFrame, known: DataFrame, truth: str, id_col: str, path: str, k: int) -> dict:
    spark = rows.sparkSession
    anchors = (F.col("_active") == "anchor") & F.col(truth).isNotNull()
    w, y = F.when(anchors, F.col("weight")), F.when(anchors, F.col(truth).cast("double"))
    a = known.agg(F.count("_active").alias("n_revealed"), F.count_if(F.col("_active") == "anchor").alias("n_anchors"), F.coalesce(F.sum(y), F.lit(0)).cast("long").alias("anchor_positives"), F.sum(w * y).alias("wy"), F.sum(w).alias("w"), F.sum(w * w).alias("w2")).first()
    rate = a["wy"] / a["w"] if a["w"] else None
    se = (max(rate * (1 - rate), 1e-12) / (a["w"] ** 2 / a["w2"])) ** 0.5 if a["w"] else None
    held = scores.join(holdout, id_col, "left_semi").join(rows.select(id_col, truth), id_col)
    judged = held.where(F.col(truth).isNotNull()).select(F.explode(F.array(*[F.struct(F.lit(c).alias("by"), F.col(c).alias("score")) for c in ("mean", "control")])).alias("x"), (F.col(truth) == 1).alias("positive")).select("x.*", "positive")
    ap = {r["by"]: r["ap"] for r in S.average_precision(judged, "score", F.col("positive"), F.lit(1.0), ["by"]).collect()}
    now = held.select(id_col, (F.col("mean") > 0.5).alias("now"))
    if k > 1:
        was = spark.read.parquet(f"{path}/scores/round={k - 1}").select(id_col, (F.col("mean") > 0.5).alias("was"))
        c = now.join(was, id_col).agg(F.count_if(F.col("now") != F.col("was")).alias("x"), F.count_if(F.col("now") | F.col("was")).alias("n"), F.count_if("was").alias("old")).first()
    churn = 1.0 if k == 1 or not c["old"] else c["x"] / max(c["n"], 1)
    return {
        "n_revealed": a["n_revealed"], "n_anchors": a["n_anchors"], "anchor_positives": a["anchor_positives"], "anchor_rate": rate, "anchor_se": se, "holdout_ap": ap.get("mean"), "control_ap": ap.get("control"),
        "churn": churn, "mean_spread": scores.agg(F.avg("spread")).first()[0],
    }


def self_training(rows: DataFrame, label: str, size: int, path: str, rounds: int = 4, low: float = 0.5, high: float = 0.5, group: str | None = None, id_col: str = "id", **sgd) -> DataFrame:
    """Figures of rounds in which a model is fitted, labels the rows without a label, and is fitted again on both: round, train_rows, train_positives, pool_rows, pool_positives,
    changed (pseudo-labels that aren't those of the round before), group_positives (positives of the pool for which the column `group` is true), stopped.

    A pool row scored at least `high` is a positive, one below `low` a negative, one between them isn't used. Ends at a fixed point, when no pseudo-label changes, or after `rounds`. Labels
    that were given never change. The state is under path, as in `active_loop`."""
    if low > high:
        raise ValueError("low must not exceed high")
    spark = rows.sparkSession
    schema = "round int, train_rows long, train_positives long, pool_rows long, pool_positives long, changed long, group_positives long, stopped string"
    none = F.lit(None).cast("int")
    for k in range(rounds):
        if _exists(spark, f"{path}/figures/round={k}"):
            if spark.read.parquet(f"{path}/figures/round={k}").first()["stopped"] is not None:
                break
            continue
        before = spark.read.parquet(f"{path}/labels/round={k - 1}") if k else rows.where(F.col(label).isNull()).select(id_col, none.alias("pseudo"))
        known = rows.join(before, id_col, "left").withColumn("_y", F.coalesce(F.col(label).cast("int"), F.col("pseudo")))
        ready, _ = linear.balanced(known.select(id_col, "vector", linear.tasks((0, F.col("_y"), 1.0)).alias("tasks")).where(F.size("tasks") > 0))
        model = linear.fit_sgd(ready, 1, size, id_col, **sgd)
        pool = linear.scored(rows.where(F.col(label).isNull()).select(id_col, "vector"), model, id_col)
        pool.select(id_col, F.when(F.col("score") >= high, 1).when(F.col("score") < low, 0).alias("pseudo")).write.mode("overwrite").parquet(f"{path}/labels/round={k}")
        now = spark.read.parquet(f"{path}/labels/round={k}")
        t = known.where("_y IS NOT NULL").agg(F.count("*").alias("n"), F.coalesce(F.sum("_y"), F.lit(0)).alias("p")).first()
        flags = rows.select(id_col, (F.col(group) if group else F.lit(False)).alias("_g"))
        c = now.join(before.withColumnRenamed("pseudo", "_was"), id_col, "left").join(flags, id_col).agg(
            F.count("*").alias("n"), F.count_if(F.col("pseudo") == 1).alias("p"), F.count_if(~F.col("pseudo").eqNullSafe(F.col("_was"))).alias("x"), F.count_if((F.col("pseudo") == 1) & F.col("_g")).alias("g")
        ).first()
        stopped = "fixed" if k and c["x"] == 0 else "rounds" if k == rounds - 1 else None
        spark.createDataFrame([(k, t["n"], t["p"], c["n"], c["p"], c["x"], c["g"], stopped)], schema).write.mode("overwrite").parquet(f"{path}/figures/round={k}")
        if stopped:
            break
    done = [j for j in range(rounds) if _exists(spark, f"{path}/figures/round={j}")]
    return spark.read.schema(schema).parquet(*[f"{path}/figures/round={j}" for j in done]) if done else spark.createDataFrame([], schema)
