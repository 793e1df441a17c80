"""Steps over many partitions: what a stage costs besides its rows is its tasks."""

import pytest

PARTITIONS = 24


@pytest.fixture
def tasks(spark):
    """Gives the number of tasks that a function runs, with PARTITIONS partitions in every shuffle."""
    conf = {"spark.sql.shuffle.partitions": str(PARTITIONS), "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in conf}
    sc = spark.sparkContext

    def run(f):
        group = f"tasks-{f.__name__}"
        sc.setJobGroup(group, group)
        try:
            f()
        finally:
            for k in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
                sc.setLocalProperty(k, None)
        told = sc.statusTracker()
        stages = {s for j in told.getJobIdsForGroup(group) for s in told.getJobInfo(j).stageIds}
        return sum(x.numCompletedTasks for s in stages if (x := told.getStageInfo(s)))

    for k, v in conf.items():
        spark.conf.set(k, v)
    yield run
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_components(spark, tasks):
    """A path, stars that overlap, and rows that repeat: few rounds, each of few exchanges."""
    from framelens.llm.graph import components

    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] * 3 + [(120, 200 + i) for i in range(40)]
    got = []

    def whole():
        got.extend(components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect())

    n = tasks(whole)
    want = {**{i: 0 for i in range(1, 61)}, **{100 + i: 100 for i in range(1, 50)}, **{200 + i: 100 for i in range(40)}}
    assert len(got) == len(want) and {r["id"]: r["root"] for r in got} == want
    assert n <= 30 * PARTITIONS  # 50 by rounds that end when nothing changes


def test_line_dedup(spark, tasks):
    from framelens.llm.line_dedup import dedup_lines

    docs = spark.createDataFrame([(i, f"a line of number {i // 2}\na line of all\nits own line {i}") for i in range(40)], "doc_id long, text string").repartition(4)
    got = []

    def whole():
        got.extend(dedup_lines(docs).select("doc_id", "n_dropped").collect())

    n = tasks(whole)
    assert sorted((r["doc_id"], r["n_dropped"]) for r in got) == [(i, i % 2 + (i > 0)) for i in range(40)]
    assert n <= 40 * PARTITIONS  # 73 by a join for each run and each batch


def test_chunks(monkeypatch):
    """Edges of more than a chunk: every chunk's stars connect what its edges connected."""
    import numpy as np
    import pyarrow as pa
    from framelens.llm import graph

    monkeypatch.setattr(graph, "CHUNK", 3)
    edges = pa.RecordBatch.from_arrays([pa.array(np.arange(1, 9)), pa.array(np.arange(8))], ["u", "v"])
    got = [list(zip(*(c.to_pylist() for c in b.columns), strict=True)) for b in graph._contracted([edges, edges.slice(0, 0), edges.slice(7)])]
    assert got == [[(1, 0), (2, 0), (3, 0)], [(4, 3), (5, 3), (6, 3)], [(7, 6), (8, 6)]]
