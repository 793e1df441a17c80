"""Linear models for log loss by averaged stochastic gradient descent, trained in partitions that are averaged each pass.

Rows are dealt to PARTS parts by the md5 of their id and taken in that order, whatever the cluster: the same rows give the
same model. In a pass each part runs through its rows from the common weights; the weights after it are the mean of the parts' by their
rows, and the model is the mean of all weights that any step has left. With one part that is the plain algorithm.

Many models are trained in one run over the rows: a row says which it trains and with which label and weight. A pass
broadcasts and brings back `size` numbers for each model, a bound that doesn't depend on the rows."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelens.learning import packing

ROWS_A_PART = 20_000
TASKS = "array<struct<model:int,label:double,weight:double>>"


@dataclass
class Models:
    """Weights by model, bias last. constant: the score of a model whose rows have one label."""

    size: int
    weights: np.ndarray
    constant: dict[int, float] = field(default_factory=dict)
    losses: dict[int, list[float]] = field(default_factory=dict)


def tasks(*each: tuple[int, Column, Column | float]) -> Column:
    """The models that a row trains: (model, label, weight), left out where the label is null."""
    made = [F.when(label.isNotNull(), F.struct(F.lit(m).alias("model"), label.cast("double").alias("label"), (w if isinstance(w, Column) else F.lit(w)).cast("double").alias("weight"))) for m, label, w in each]
    return F.array_compact(F.array(*made))


def balanced(rows: DataFrame) -> tuple[DataFrame, dict[int, tuple[float, float]]]:
    """rows with weights so that both labels of a model weigh the same and the mean weight of its rows is one; and the weight of (0, 1) by model."""
    g = rows.select(F.explode("tasks").alias("t")).groupBy("t.model", "t.label").agg(F.sum("t.weight").alias("w"), F.count("*").alias("n")).collect()
    total = {(r["model"], r["label"]): r["w"] for r in g}
    n: dict[int, int] = {}
    for r in g:
        n[r["model"]] = n.get(r["model"], 0) + r["n"]
    by = {m: tuple(n[m] / (2 * total[m, y]) if (m, y) in total else 0.0 for y in (0.0, 1.0)) for m in n}
    if not by:
        return rows, by
    factor = F.create_map(*[x for m, (a, b) in by.items() for x in (F.lit(m), F.array(F.lit(a), F.lit(b)))])
    again = F.transform("tasks", lambda t: F.struct(t["model"].alias("model"), t["label"].alias("label"), (t["weight"] * F.get(F.element_at(factor, t["model"]), t["label"].cast("int"))).alias("weight")))
    return rows.withColumn("tasks", again), by


class _Run:
    """One part of a pass, its models one after the other in each row: w = scale * v, and the sum of all w as mass * v - held, so that a step costs what
    its row has. A place of a model holds v and held, read and written as one complex number; the bias is beside them."""

    def __init__(self, start: np.ndarray, alpha: float, rate: float, steps: np.ndarray):
        k = len(start)
        self.both = [w[:-1].astype(complex) for w in start]
        self.bias, self.bias_held = start[:, -1].tolist(), [0.0] * k
        self.scale, self.mass, self.steps, self.done = [1.0] * k, [0.0] * k, steps.tolist(), [0] * k
        self.alpha, self.rate = alpha, rate
        self.loss, self.seen = [0.0] * k, [0.0] * k

    def step(self, at: np.ndarray, x: np.ndarray, m: np.ndarray, label: np.ndarray, weight: np.ndarray) -> None:
        """A row that trains the models m, each at most once; the others stay as they are."""
        at = at.astype(np.intp)
        for i, y, w in zip(m.tolist(), label.tolist(), weight.tolist(), strict=True):
            near = self.both[i][at]
            z = self.scale[i] * float(x @ near.real) + self.bias[i]
            small = math.exp(-abs(z))
            self.loss[i] += w * (max(z, 0.0) - z * y + math.log1p(small))
            self.seen[i] += w
            eta = self.rate / (1.0 + self.alpha * self.rate * self.steps[i])
            move = -eta * w * ((1.0 if z >= 0 else small) / (1.0 + small) - y)
            self.scale[i] *= 1.0 - eta * self.alpha
            by = move / self.scale[i]
            near += x * complex(by, self.mass[i] * by)
            self.both[i][at] = near
            self.bias_held[i] += self.done[i] * move  # the bias doesn't shrink
            self.bias[i] += move
            self.mass[i] += self.scale[i]
            self.steps[i] += 1
            self.done[i] += 1
            if self.scale[i] < 1e-6:
                self._rescale(i)

    def _rescale(self, i: int) -> None:
        # the sum so far is mass * v - held; with v' = scale * v it is (mass / scale) * v' - held
        self.both[i].real *= self.scale[i]
        self.mass[i] /= self.scale[i]
        self.scale[i] = 1.0

    def result(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        v, held = self.both[i].real, self.both[i].imag
        return np.append(self.scale[i] * v, self.bias[i]), np.append(self.mass[i] * v - held, self.done[i] * self.bias[i] - self.bias_held[i])


_BYTES = [*packing.FIELDS, "models", "labels", "weights"]
_pack, _unpack = packing.pack, packing.unpack


def _packed(size: int):
    """Rows with their vector and tasks as bytes: a fraction of the size, moved and kept as they are. Each task of a pass reads them."""

    def run(batches):
        for b in batches:
            given = [[t.values.field(i).to_numpy().tobytes() for i in range(3)] for t in b.column("tasks")]
            kept = ["part", "_at", "_id"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *packing.parts(b.column("vector"), size), *(pa.array([g[i] for g in given], pa.binary()) for i in range(3))], [*kept, *_BYTES])

    return run


def _pass(shared, alpha: float, rate: float, live: list[int]):
    """A pass of some models. shared: the weights of all models, and for each part the steps that they have taken."""

    def run(batches):
        part, now = None, None
        place = np.full(max(live) + 1, -1)
        place[live] = np.arange(len(live))

        def out():
            for i, m in enumerate(live):
                if now is not None and now.done[i]:
                    last, total = now.result(i)
                    n = int(now.done[i])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([m], pa.int32()), pa.array([part], pa.int32()), pa.array([n], pa.int64()), pa.array([(n * last).tobytes()], pa.binary()), pa.array([total.tobytes()], pa.binary()), pa.array([now.loss[i]]), pa.array([now.seen[i]])],
                        ["model", "part", "n", "last", "total", "loss", "seen"],
                    )

        for b in batches:
            for p, *row in zip(b.column(0).to_pylist(), *(b.column(i) for i in range(1, 1 + len(_BYTES))), strict=True):
                if p != part:
                    yield from out()
                    weights, steps = shared.value
                    part, now = p, _Run(weights[live], alpha, rate, steps[p, live])
                m, label, weight = (np.frombuffer(c.as_buffer(), kind) for c, kind in zip(row[3:], (np.int32, np.float64, np.float64), strict=True))
                m = np.where(m < len(place), place[np.minimum(m, len(place) - 1)], -1)
                if (m < 0).any():
                    m, label, weight = m[m >= 0], label[m >= 0], weight[m >= 0]
                if len(m):
                    now.step(*_unpack(*(c.as_buffer() for c in row[:3]), weights.shape[1] - 1), m, label, weight)
        yield from out()

    return run


_OUT = "model int, part int, n long, last binary, total binary, loss double, seen double"


def _summed(batches):
    sums: dict[int, list] = {}
    for b in batches:
        for r in b.to_pylist():
            new = [r["n"], np.frombuffer(r["last"]), np.frombuffer(r["total"]), r["loss"], r["seen"]]
            old = sums.get(r["model"])
            sums[r["model"]] = [x + y for x, y in zip(old, new, strict=True)] if old else new
    for m, (n, last, total, loss, seen) in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([m], pa.int32()), pa.array([0], pa.int32()), pa.array([n], pa.int64()), pa.array([last.tobytes()], pa.binary()), pa.array([total.tobytes()], pa.binary()), pa.array([loss]), pa.array([seen])], ["model", "part", "n", "last", "total", "loss", "seen"])


def fit_sgd(rows: DataFrame, models: int, size: int, id_col: str = "id", alpha: float = 1e-5, rate: float = 0.5, passes: int = 20, tol: float = 1e-4, patience: int = 5, parts: int | None = None) -> Models:
    """rows: id, vector (array of index and value, or packed for `size`) and tasks (see `tasks`; a row trains a model at most once). A model ends after `passes` or when its own loss hasn't improved by tol for
    `patience` passes, so that no model depends on the rows of another. A model whose rows all have one label, or that has no rows, is constant: that label, or a half."""
    if not 0 < alpha * rate < 1:
        raise ValueError("alpha times rate must lie between 0 and 1")
    spark = rows.sparkSession
    seen = rows.select(F.explode("tasks").alias("t")).groupBy("t.model").agg(F.min("t.label").alias("low"), F.max("t.label").alias("high"), F.min("t.weight").alias("least"), F.count("*").alias("n")).collect()
    if any(r["least"] <= 0 for r in seen):
        raise ValueError("weights must be positive")
    constant = {m: 0.5 for m in range(models)} | {r["model"]: r["low"] for r in seen if r["low"] == r["high"]}
    constant = {m: c for m, c in constant.items() if m not in {r["model"] for r in seen if r["low"] != r["high"]}}
    out = Models(size, np.zeros((models, size + 1)), constant)
    live = [m for m in range(models) if m not in constant]
    if not live:
        return out
    parts = parts or -(-max(r["n"] for r in seen) // ROWS_A_PART)
    digest = F.md5(F.col(id_col).cast("string"))
    part = F.pmod(F.conv(F.substring(digest, 9, 7), 16, 10).cast("long"), F.lit(parts)).cast("int")
    given = F.filter("tasks", lambda t: t["model"].isin(live))
    dealt = rows.select(part.alias("part"), "vector", given.alias("tasks"), digest.alias("_at"), F.col(id_col).alias("_id")).where(F.size("tasks") > 0)
    packed = dealt.mapInArrow(_packed(size), f"part int, _at string, _id {rows.schema[id_col].dataType.simpleString()}, {', '.join(f'{c} binary' for c in _BYTES)}")
    # one part a task, whatever its number hashes to; kept as rows, as a cached plan isn't found again below a union, and
    # on disk, as a pass reads them once and in order, and the heap is for what reads and sorts vectors
    dealt = packed.repartitionById(parts, "part").sortWithinPartitions("part", "_at", "_id").select("part", *_BYTES).localCheckpoint(storageLevel=StorageLevel.DISK_ONLY)

    weights, total, count = np.zeros((models, size + 1)), np.zeros((models, size + 1)), np.zeros(models)
    steps = np.zeros((parts, models), np.int64)
    best, stale = dict.fromkeys(live, math.inf), dict.fromkeys(live, 0)
    out.losses = {m: [] for m in live}
    for _ in range(passes):
        shared = spark.sparkContext.broadcast((weights, steps))
        # models don't meet within a pass: where there are fewer parts than cores, several tasks read a part, each for some models
        groups = min(len(live), -(-spark.sparkContext.defaultParallelism // parts))
        # a megabyte for each part and model, as many as the rows make: on disk
        taken = reduce(DataFrame.union, [dealt.mapInArrow(_pass(shared, alpha, rate, live[i::groups]), _OUT) for i in range(groups)]).persist(StorageLevel.DISK_ONLY)
        for r in taken.select("model", "part", "n").collect():
            steps[r["part"], r["model"]] += r["n"]
        for r in taken.repartitionById(len(live), F.array_position(F.array(*map(F.lit, live)), F.col("model")).cast("int") - 1).sortWithinPartitions("model", "part").mapInArrow(_summed, _OUT).collect():
            m, loss = r["model"], r["loss"] / r["seen"]
            weights[m] = np.frombuffer(r["last"]) / r["n"]
            total[m] += np.frombuffer(r["total"])
            count[m] += r["n"]
            out.losses[m].append(loss)
            stale[m] = 0 if loss < best[m] - tol else stale[m] + 1
            best[m] = min(best[m], loss)
        taken.unpersist()
        shared.unpersist()
        live = [m for m in live if stale[m] < patience]
        if not live:
            break
    dealt._jdf.logicalPlan().rdd().unpersist(False)  # else it stays until the driver happens to collect its garbage
    out.weights = total / np.maximum(count, 1)[:, None]
    return out


def scored(rows: DataFrame, models: Models, id_col: str = "id", only: Column | None = None, margin: bool = False) -> DataFrame:
    """id, model and score of each row by each model; only: an array of the models that a row is scored by. margin: the logit instead of
    the probability; constant models have an infinite one, written as plus or minus 50."""
    shared = rows.sparkSession.sparkContext.broadcast(models)
    chosen = only if only is not None else F.array(*[F.lit(m) for m in range(len(models.weights))])

    def run(batches):
        known = shared.value
        for b in batches:
            ids, ms, out = [], [], []
            for i, (at, x), which in zip(b.column(0), packing.each(b.column(1), known.size), b.column(2).to_pylist(), strict=True):
                for m in which:
                    if m in known.constant:
                        c = known.constant[m]
                        z = 0.0 if c == 0.5 else 50.0 if c else -50.0
                        p = c
                    else:
                        w = known.weights[m]
                        z = float(w[at] @ x + w[-1])
                        p = 1.0 / (1.0 + math.exp(-z)) if z > -700 else 0.0
                    ids.append(i)
                    ms.append(m)
                    out.append(z if margin else p)
            yield pa.RecordBatch.from_arrays([pa.array([i.as_py() for i in ids], b.schema.field(0).type), pa.array(ms, pa.int32()), pa.array(out, pa.float64())], ["id", "model", "score"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(F.col(id_col).alias("id"), "vector", chosen.alias("_which")).mapInArrow(run, f"id {kind}, model int, score double").withColumnRenamed("id", id_col)
