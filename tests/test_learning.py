"""Features, gradient descent, calibration and loops against plain computations."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelens.learning import calibration, features, linear, loops


def test_char_windows(spark):
    df = spark.createDataFrame([("Ab  c",), ("",), (None,), ("é",), ("wörter",)], "t string")
    got = [sorted(r[0]) for r in df.select(features.char_windows(F.col("t"))).collect()]

    def plain(t):
        out = []
        for w in (t or "").lower().split():
            w = f" {w} "
            for n in (3, 4, 5):
                if n > 3 and len(w) < n:
                    break
                out += [w[i : i + n] for i in range(max(1, len(w) - n + 1))]
        return sorted(out)

    assert got == [plain(t) for t in ("Ab  c", "", None, "é", "wörter")]
    assert [r[0] for r in df.select(features.char_windows(F.col("t"), 4, 4)).collect()][3] == [" é "]
    two = spark.createDataFrame([("A bc, de-fg x",), (None,)], "t string").select(features.word_windows(F.col("t"))).collect()
    assert two[0][0] == ["bc", "de", "fg", "bc de", "de fg"] and two[1][0] == []


def test_counts_and_buckets(spark):
    df = spark.createDataFrame([(["b", "a", "b"],), ([],)], "w array<string>")
    assert [[tuple(x) for x in r[0]] for r in df.select(features.counted(F.col("w"))).collect()] == [[("a", 1), ("b", 2)], []]
    one = df.select(features.hashed(features.counted(F.col("w")), 1, signed=True), features.hashed(features.counted(F.col("w")), 1 << 18), features.beside(F.array(), features.hashed(features.counted(F.col("w")), 1), 7)).collect()
    assert [abs(x["value"]) for x in one[0][0]] in ([1.0], []) and one[1][0] == [] and one[1][1] == []
    assert sorted(round(x["value"], 6) for x in one[0][1]) == [round(1 / 5**0.5, 6), round(2 / 5**0.5, 6)]
    assert [x["index"] for x in one[0][2]] == [7]


def data(n, size, seed):
    rng = np.random.default_rng(seed)
    truth, out = rng.normal(size=size), []
    for i in range(n):
        at = np.sort(rng.choice(size, rng.integers(0, size // 2), replace=False))
        x = rng.normal(size=len(at))
        out.append((i, [(int(a), float(v)) for a, v in zip(at, x, strict=True)], int(truth[at] @ x + rng.normal() > 0), float(rng.uniform(0.5, 2))))
    return out


SCHEMA = "id long, vector array<struct<index:int,value:double>>, y int, w double"


def plain_sgd(rows, size, alpha, rate, passes):
    import hashlib

    rows = sorted(rows, key=lambda r: hashlib.md5(str(r[0]).encode()).hexdigest())
    w, total, t = np.zeros(size + 1), np.zeros(size + 1), 0
    for _ in range(passes):
        for _, v, y, weight in rows:
            x = np.zeros(size + 1)
            for a, b in v:
                x[a] = b
            x[-1] = 1
            eta = rate / (1 + alpha * rate * t)
            slope = weight * (1 / (1 + math.exp(-(w @ x))) - y)
            w[:-1] *= 1 - eta * alpha
            w -= eta * slope * x
            total += w
            t += 1
    return total / t


@pytest.mark.parametrize("alpha", [1e-5, 0.9])
def test_sgd_equals_a_plain_loop(spark, alpha):
    rows = data(200, 20, 1)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).select("id", "vector", linear.tasks((0, F.col("y"), F.col("w")), (1, 1 - F.col("y"), 1.0), (2, F.lit(1), 1.0)).alias("tasks"))
    got = linear.fit_sgd(df, 4, 20, alpha=alpha, rate=0.5, passes=7, patience=99, parts=1)
    assert np.allclose(got.weights[0], plain_sgd(rows, 20, alpha, 0.5, 7), atol=1e-9)
    assert np.allclose(got.weights[1], plain_sgd([(i, v, 1 - y, 1.0) for i, v, y, _ in rows], 20, alpha, 0.5, 7), atol=1e-9)
    assert got.constant == {2: 1.0, 3: 0.5} and [len(x) for x in got.losses.values()] == [7, 7]
    again = linear.fit_sgd(df.repartition(2), 4, 20, alpha=alpha, rate=0.5, passes=7, patience=99, parts=1)
    assert (again.weights == got.weights).all()


def test_sgd_in_parts(spark):
    rows = data(600, 20, 2)
    df = spark.createDataFrame(rows, SCHEMA).select("id", "vector", "y", linear.tasks((0, F.col("y"), 1.0)).alias("tasks"))
    models = linear.fit_sgd(df, 1, 20, passes=30, parts=4)
    assert models.losses[0][-1] < models.losses[0][0] - 0.05
    right = linear.scored(df, models).join(df, "id").where((F.col("score") > 0.5) == (F.col("y") == 1)).count()
    whole = linear.fit_sgd(df, 1, 20, passes=30, parts=1)
    alone = linear.scored(df, whole).join(df, "id").where((F.col("score") > 0.5) == (F.col("y") == 1)).count()
    assert right > 420 and right > alone - 20
    z = linear.scored(df, models, margin=True).join(linear.scored(df, models).withColumnRenamed("score", "p"), ["id", "model"]).where("abs(1 / (1 + exp(-score)) - p) > 1e-9")
    assert z.count() == 0
    bad = df.select("id", "vector", linear.tasks((0, F.col("y"), -1.0)).alias("tasks"))
    with pytest.raises(ValueError, match="positive"):
        linear.fit_sgd(bad, 1, 20)
    assert linear.fit_sgd(df.limit(0), 2, 20).constant == {0: 0.5, 1: 0.5}


def test_balanced(spark):
    df = spark.createDataFrame([(i, int(i < 2), 1.0 + i) for i in range(10)], "id int, y int, w double").select("id", linear.tasks((0, F.col("y"), F.col("w"))).alias("tasks"))
    out, _ = linear.balanced(df)
    sums = {r["label"]: r["w"] for r in out.select(F.explode("tasks").alias("t")).groupBy("t.label").agg(F.sum("t.weight").alias("w")).collect()}
    assert sums[0.0] == pytest.approx(5) and sums[1.0] == pytest.approx(5)


def direct_sigmoid(rows):
    """The same loss by many small gradient steps from several scales."""
    n1 = sum(y for _, y in rows)
    high, low = (n1 + 1) / (n1 + 2), 1 / (len(rows) - n1 + 2)
    s, t = np.array([x for x, _ in rows]), np.array([high if y else low for _, y in rows])
    w = np.zeros(2)
    for _ in range(200):
        z = w[0] * s + w[1]
        p = 1 / (1 + np.exp(z))
        g = np.array([(s * (t - p)).sum(), (t - p).sum()])
        h = np.array([[(s * s * p * (1 - p)).sum(), (s * p * (1 - p)).sum()], [(s * p * (1 - p)).sum(), (p * (1 - p)).sum()]]) + 1e-9 * np.eye(2)
        w = w - 0.5 * np.linalg.solve(h, g)
    return w


def test_sigmoid(spark):
    rng = random.Random(5)
    groups = {"a": [(x := rng.gauss(0, 2), int(rng.random() < 1 / (1 + math.exp(-0.7 * x + 0.4)))) for _ in range(500)], "b": [(x, int(x > 0)) for x in range(-20, 20)]}
    rows = [(g, float(s), y) for g, r in groups.items() for s, y in r] + [("a", 1.0, None), ("c", 0.5, 1), ("c", 0.7, 1)]
    df = spark.createDataFrame(rows, "g string, score double, label int")
    fits = calibration.fit_sigmoid(df, "g")
    for g, r in groups.items():
        assert fits[g] == pytest.approx(tuple(direct_sigmoid(r)), rel=1e-4, abs=1e-4)
    assert math.isfinite(fits["c"][0]) and calibration.fit_sigmoid(df.limit(0), "g") == {}
    out = calibration.calibrated(df.where("g = 'a' AND label IS NOT NULL"), "g", fits)
    assert abs(out.agg(F.avg(F.col("probability") - F.col("label"))).first()[0]) < 0.01


def test_calibrated_out_of_fold(spark, tmp_path):
    rows = [(i, v, y, i % 4, (i // 4) % 3) for i, v, y, _ in data(480, 16, 4)]
    df = spark.createDataFrame(rows, "id long, vector array<struct<index:int,value:double>>, label int, fold int, part int")
    out = calibration.calibrated_oof(df, 16, 4, str(tmp_path / "m"), passes=25, parts=1, rate=3.0)
    assert out.count() == 480 and out.where("probability IS NULL OR probability < 0 OR probability > 1").count() == 0
    brier = out.agg(*[F.avg(F.pow(F.col(c) - F.col("label"), F.lit(2.0))).alias(c) for c in ("plain", "probability")]).first()
    assert brier["probability"] <= brier["plain"] + 0.002
    # the labels of a fold don't reach its own scores
    other = df.withColumn("label", F.when(F.col("fold") == 0, 1 - F.col("label")).otherwise(F.col("label")))
    again = calibration.calibrated_oof(other, 16, 4, str(tmp_path / "n"), passes=25, parts=1, rate=3.0)
    a, b = ({r["id"]: r["probability"] for r in x.where("fold = 0").collect()} for x in (out, again))
    assert a == pytest.approx(b, abs=1e-9)


@pytest.fixture(scope="module")
def learnable(spark):
    rows = [(i, v, y, 1.0 + i % 3) for i, v, y, _ in data(240, 12, 6)]
    df = spark.createDataFrame(rows, "id long, vector array<struct<index:int,value:double>>, y int, weight double")
    return df.withColumns({"a": F.col("y"), "b": F.when(F.col("id") % 9 == 0, 1 - F.col("y")).otherwise(F.col("y"))}).cache()


def state(spark, path):
    return sorted((r["id"], r["role"], r["arm"], r["round"]) for r in spark.read.parquet(f"{path}/taken").collect())


def test_active_loop_resumes(spark, learnable, tmp_path):
    plan = loops.Plan(rounds=3, disagree=8, uncertain=8, anchors=4)
    run = lambda path, p=plan: sorted(tuple(r) for r in loops.active_loop(learnable, ["a", "b"], "y", 12, path, p, passes=4, parts=2).collect())
    whole = run(str(tmp_path / "x"))
    assert [r[0] for r in whole] == [1, 2, 3] and [r[1] for r in whole] == [20, 40, 60] and [r[2] for r in whole] == [0, 4, 8] and whole[-1][-1] == "rounds"
    # a driver that was lost in the second round: its figures are missing
    path = str(tmp_path / "y")
    run(path, loops.Plan(rounds=3, disagree=8, uncertain=8, anchors=4))
    import shutil

    shutil.rmtree(f"{path}/figures/round=2"), shutil.rmtree(f"{path}/figures/round=3"), shutil.rmtree(f"{path}/taken/round=2"), shutil.rmtree(f"{path}/taken/round=3")
    assert run(path) == whole and state(spark, path) == state(spark, str(tmp_path / "x"))
    taken, held = state(spark, path), {r["id"] for r in spark.read.parquet(f"{path}/holdout").collect()}
    assert not held & {t[0] for t in taken} and len({t[0] for t in taken if t[2] == "active"}) == len([t for t in taken if t[2] == "active"])
    assert run(path) == whole  # nothing is left to do


def test_active_loop_stops(spark, learnable, tmp_path):
    small = learnable.where("id < 60")
    out = loops.active_loop(small, ["a", "b"], "y", 12, str(tmp_path / "x"), loops.Plan(rounds=9, disagree=8, uncertain=8, anchors=4), passes=2, parts=1).collect()
    assert max(r["round"] for r in out) < 9 and [r["stopped"] for r in sorted(out)][-1] == "pool"
    still = loops.active_loop(learnable, ["a", "b"], "y", 12, str(tmp_path / "z"), loops.Plan(rounds=9, disagree=2, uncertain=2, anchors=1, churn=1.0, gain=1.0), passes=2, parts=1).collect()
    assert sorted(still)[-1]["stopped"] == "still" and len(still) == 3


def test_self_training(spark, learnable, tmp_path):
    rows = learnable.withColumn("label", F.when(F.col("id") < 80, F.col("y"))).withColumn("odd", F.col("id") % 2 == 1)
    out = sorted(loops.self_training(rows, "label", 12, str(tmp_path / "s"), rounds=8, group="odd", passes=10, parts=1).collect())
    assert out[0]["train_rows"] == 80 and out[0]["pool_rows"] == 160 and all(r["train_rows"] == 240 for r in out[1:])
    assert out[-1]["stopped"] in ("fixed", "rounds") and (out[-1]["stopped"] != "fixed" or out[-1]["changed"] == 0) and out[0]["group_positives"] <= out[0]["pool_positives"]
    unsure = sorted(loops.self_training(rows, "label", 12, str(tmp_path / "t"), rounds=2, low=0.2, high=0.8, passes=10, parts=1).collect())
    assert 80 <= unsure[1]["train_rows"] < 240
    again = loops.self_training(rows, "label", 12, str(tmp_path / "s"), rounds=8, group="odd", passes=10, parts=1)
    assert sorted(again.collect()) == out
    with pytest.raises(ValueError, match="low"):
        loops.self_training(rows, "label", 12, str(tmp_path / "u"), low=0.9, high=0.1)
