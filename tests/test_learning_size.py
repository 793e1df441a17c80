"""Features of whole texts in batches, models of a part side by side, and joins by a small vocabulary."""

import math

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from framelens.learning import calibration, features, linear, packing
from framelens.plans import learning
from tests.conftest import SF
from tests.test_learning import SCHEMA, data


def test_vectors_in_batches(spark):
    """As the expressions have them, also for texts of more characters than a window's bits hold."""
    texts = [None, "", " a  é \n\t x", "İstanbul ßtraße ÉCOLE 𝒳𝒴𝒵𝒲 a-b c_d", "aa aa aa bb cc", "".join(chr(0x4E00 + i) for i in range(4200)), "x" * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    parts = [features.hashed(features.counted(w(F.col("text"))), 512, sublinear=True) for w in (features.word_windows, features.char_windows)]
    want = dict(df.select("id", features.beside(*parts, 512)).collect())
    got = dict(features.with_vectors(df, "text", 512).collect())
    for i, v in want.items():
        assert [x["index"] for x in got[i]] == [x["index"] for x in v]
        assert np.allclose([x["value"] for x in got[i]], [x["value"] for x in v], atol=1e-12)


def test_models_side_by_side(spark):
    """A model is the same alone and among others, whichever tasks they share, and every part is in a task of its own."""
    df = spark.createDataFrame(data(120, 12, 3), SCHEMA)
    own = [(0, F.col("y"), F.col("w")), (1, 1 - F.col("y"), 1.0), (2, F.when(F.col("id") % 3 != 0, F.col("y")), 1.0)]
    fit = lambda ts, n, parts: linear.fit_sgd(df.select("id", "vector", linear.tasks(*ts).alias("tasks")), n, 12, passes=2, parts=parts)
    for parts in (1, 5):
        together = fit(own, 3, parts)
        assert np.allclose(fit([(0, *own[2][1:])], 1, parts).weights[0], together.weights[2], atol=1e-12)


def test_tfidf_broadcasts_the_vocabulary(spark):
    """The exploded windows of a small file pass for small too; they stay where they are."""
    df = spark.createDataFrame([(i, f"ab{i} cd") for i in range(50)], "id int, name string")
    plan = features.tfidf(df, "id", features.char_windows(F.col("name")), 1, 10)._jdf.queryExecution().sparkPlan().toString()
    join = next(x for x in plan.splitlines() if "BroadcastHashJoin [term" in x)
    assert "BuildRight" in join and "Inner" in join


def test_packed_vectors():
    """What each task of a pass reads: a third of index and value for the vectors of texts, and the same numbers back."""
    rng = np.random.default_rng(1)
    at = np.sort(rng.choice(1 << 16, 3000, replace=False)).astype(np.int32)
    for x in ((1 + np.log(rng.integers(1, 9, 3000))) / 41, rng.random(3000), np.zeros(0), rng.random(70_000)):
        own = at if len(x) == 3000 else np.arange(len(x), dtype=np.int32)
        for size in (1 << 17,) if len(x) > 3000 else (1 << 16, 1 << 17):
            kept = linear._pack(own, x, size)
            back = linear._unpack(*kept, size)
            assert (back[0] == own).all() and (back[1] == x).all()
    kept = linear._pack(at, (1 + np.log(rng.integers(1, 9, 3000))) / 41, 1 << 16)
    assert sum(map(len, kept)) < (at.nbytes + 8 * len(at)) / 2.9


def test_sigmoid_fit_reads_once_a_step(spark):
    """Three jobs a step: two small tables and one pass."""
    df = spark.createDataFrame([(i % 2, math.sin(i), int(math.sin(i) + 0.8 * math.cos(7 * i) > 0)) for i in range(400)], "g int, score double, label int").coalesce(1)
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup("fit"))
    spark.sparkContext.setJobGroup("fit", "fit")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        calibration.fit_sigmoid(df, "g", rounds=1)
        one = jobs()
        calibration.fit_sigmoid(df, "g", rounds=3)
        three = jobs() - one
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert three - one == 2 * 3


def test_packed_vectors_train_and_score_as_arrays(spark):
    """Vectors as bytes have the numbers of the arrays, and so have the models and scores made of them; a null is an empty vector."""
    texts = [None, "", "aa bb aa", "İstanbul ßtraße"] + [f"w{i % 7} w{i % 5} {'x' * (i % 9)} w{i}" for i in range(60)]
    df = spark.createDataFrame([(i, t, i % 3 % 2) for i, t in enumerate(texts)], "id long, text string, y int").coalesce(2)
    lists, packed = (features.with_vectors(df, "text", 512, packed=p).withColumn("vector", F.expr("if(id = 9, null, vector)")).cache() for p in (False, True))
    back = {r["id"]: packing.unpack(*r["vector"], 1024) for r in packed.where("id <> 9").collect()}
    for r in lists.where("id <> 9").collect():
        assert [x["index"] for x in r["vector"]] == back[r["id"]][0].tolist() and [x["value"] for x in r["vector"]] == back[r["id"]][1].tolist()
    made = []
    for rows in (lists, packed):
        ready, _ = linear.balanced(rows.select("id", "vector", linear.tasks((0, F.col("y"), 1.0), (1, 1 - F.col("y"), 1.0)).alias("tasks")))
        models = linear.fit_sgd(ready, 2, 1024, passes=3, parts=2)
        made.append((models.weights, sorted(map(tuple, linear.scored(rows, models).collect()))))
    assert (made[0][0] == made[1][0]).all() and made[0][1] == made[1][1] and len(made[0][1]) == 2 * len(texts)


def test_vectors_are_read_in_small_groups(spark, monkeypatch):
    """Spark reads up to 4096 rows of a row group at once: none of them may be nested by element, and a group ends at its bytes (looked at from 100 rows on)."""
    monkeypatch.setattr(learning, "GROUP", 1 << 18)
    rows = learning.vectors(spark, SF.replace("sf0.001", "sf0.01"), "groups")
    assert rows.count() == 1000 and rows.schema["vector"].dataType.simpleString() == packing.SCHEMA
    groups = [[m.row_group(i).num_rows for i in range(m.num_row_groups)] for m in (pq.read_metadata(f.removeprefix("file://")) for f in rows.inputFiles())]
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "1m"
    assert any(sum(g) > 100 for g in groups) and all(max(g) <= 100 for g in groups)


def test_fit_keeps_nothing_in_memory(spark, monkeypatch):
    """The rows of a fit and what the parts of a pass return are on disk while it runs and gone after it, so that rounds don't add up."""
    stored = lambda: {x.id(): (x.memSize(), x.diskSize()) for x in spark.sparkContext._jsc.sc().getRDDStorageInfo()}
    df = spark.createDataFrame(data(60, 12, 3), SCHEMA).select("id", "vector", linear.tasks((0, F.col("y"), 1.0)).alias("tasks"))
    before, seen, free = set(spark.sparkContext._jsc.getPersistentRDDs().keys()), [], type(df).unpersist
    monkeypatch.setattr(type(df), "unpersist", lambda self, *a: (seen.append({i: x for i, x in stored().items() if i not in before}), free(self, *a))[1])
    linear.fit_sgd(df, 1, 12, passes=2, parts=3)
    assert [len(x) for x in seen] == [2, 2] and all(memory == 0 and disk > 0 for x in seen for memory, disk in x.values())
    assert set(spark.sparkContext._jsc.getPersistentRDDs().keys()) <= before
