"""Line runs over several jobs, and lines that are common beside lines that are not."""

import pytest


def dropped(df):
    return sorted((r["doc_id"], r["n_dropped"], r["kept_text"]) for r in df.select("doc_id", "n_dropped", "kept_text").collect())


def test_reopened_runs(spark):
    from framelens.llm.line_dedup import LineRuns, dedup_lines

    line = lambda k: f"this is line {k}"
    first = spark.createDataFrame([(i, f"{line(i)}\n{line(i // 2)}") for i in range(20)], "doc_id long, text string")
    runs = LineRuns(spark, fanout=2)
    dedup_lines(first, runs=runs, batches=3).count()
    again = LineRuns.reopen(spark, runs.path, fanout=2)
    keys = sorted((bytes(r["h"]), r["owner"]) for df in runs.runs() for r in df.collect())
    assert len(keys) == 20 and keys == sorted((bytes(r["h"]), r["owner"]) for df in again.runs() for r in df.collect())
    # a later job: lines of the runs go, whatever the id; new lines stay once
    later = spark.createDataFrame([(-5, f"{line(3)}\nonly here and once"), (50, f"{line(99)}\nshort"), (51, f"{line(99)}\nshort")], "doc_id long, text string")
    assert dropped(dedup_lines(later, runs=again)) == [(-5, 1, "only here and once"), (50, 0, f"{line(99)}\nshort"), (51, 1, "short")]
    assert sum(df.count() for df in LineRuns.reopen(spark, runs.path).runs()) == 22


@pytest.mark.parametrize("hot", [1, 4, 1000])
def test_common_lines(spark, monkeypatch, hot):
    from framelens.llm import line_dedup

    monkeypatch.setattr(line_dedup, "HOT", hot)
    common, rare = "a line that all documents share", "a line of every seventh"
    docs = [(i, "\n".join([f"own line of number {i}", common, *([rare] if i % 7 == 0 else [])])) for i in range(100)]
    got = dropped(line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)))
    assert got == [(i, (i > 0) + (i > 0 and i % 7 == 0), docs[i][1] if i == 0 else f"own line of number {i}") for i in range(100)]


def test_equal_rows_without_id(spark):
    from framelens.llm.line_dedup import dedup_lines

    docs = [(None, "one shared line\nb")] * 50 + [(1, "one shared line")]
    got = dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["n_dropped"]) for r in got) == [(0, 0)] * 50 + [(1, 1)]
