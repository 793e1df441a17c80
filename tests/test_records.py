"""Salvage, versions, inventories, parts and parameter lists on literal cases; empty tables and unknown keys."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from framelens.functions import text as T
from framelens.operators import contracts as C
from framelens.operators import network, salvage, sampling, stats
from framelens.operators import scores as S
from framelens.sources import files
from framelens.streaming.sync import windowed_counts


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_candidates(spark):
    df = spark.createDataFrame([(1, 2, '[{"id":"W1"}] [{"id":"W2"}]'), (1, 1, "[] text [7"), (1, 0, None), (2, 0, "nothing")], "k int, turn int, raw string")
    ok = lambda c: F.size(F.from_json(c, "array<struct<id:string>>")) > 0
    got = salvage.candidates(df, ["k"], ["turn"], F.col("raw"), ok)
    assert rows(got.where("chosen").select("k", "turn", "position", "candidate")) == [(1, 2, 0, '[{"id":"W1"}]')]
    assert got.where("NOT chosen").count() == 2


def test_versions(spark):
    old = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "v string, x int")
    new = spark.createDataFrame([("a", 9)], "v string, x int")
    assert rows(C.replace_versions(old, new, "v")) == [("a", 9), ("b", 3)]
    assert rows(C.replace_versions(old.limit(0), new, "v")) == [("a", 9)]
    registry = spark.createDataFrame([("a", 2, True), ("b", 1, False), ("c", 5, False)], "v string, row_count long, active boolean")
    assert rows(C.activated(registry, old, "v", "b").select("v", "active")) == [("a", False), ("b", True), ("c", False)]
    for wrong in ("c", "none"):
        with pytest.raises(ValueError):
            C.activated(registry, old, "v", wrong)


def test_upsert_and_sets(spark):
    old = spark.createDataFrame([(1, 1, "x"), (2, 5, "y"), (None, 1, "n")], "k int, version int, v string")
    new = spark.createDataFrame([(1, 1, "new"), (2, 4, "late"), (3, 1, "z"), (None, 2, "m")], "k int, version int, v string")
    assert rows(C.upsert(old, new, ["k"], "version")) == sorted([(1, 1, "new"), (2, 5, "y"), (3, 1, "z"), (None, 2, "m")], key=repr)
    assert rows(C.upsert(old.limit(0), new.limit(0), ["k"], "version")) == []
    assert rows(C.differing(old.where("k = 1"), new.where("k IS NOT NULL"), "k")) == [(2, "first"), (3, "first")]
    assert rows(C.among(new, "k", [3, None, 3, 8]).select("v")) == [("z",)] and C.among(new, "k", []).count() == 0
    assert [tuple(r) for r in C.served(new, ["v", "title"]).collect()] == [("v", True, 4, 0), ("title", False, 4, 4)]


def test_parts(spark, tmp_path):
    df = spark.createDataFrame([(0, "b"), (0, "aé"), (1, "c")], "part int, id string")
    path = str(tmp_path / "parts")
    said = files.write_parts(df, path, "part", "id")
    framed = b"".join(len(x.encode()).to_bytes(4, "big") + x.encode() for x in ("aé", "b"))
    assert {r["part"]: r["digest"] for r in said.collect()}[0] == hashlib.sha256(framed).hexdigest()
    assert [(r["part"], r["id"]) for r in files.merged_parts(spark, path, "part", "id").collect()] == [(0, "aé"), (0, "b"), (1, "c")]
    spark.createDataFrame([(1, "d")], "part int, id string").write.mode("append").partitionBy("part").parquet(path)
    with pytest.raises(ValueError, match="1"):
        files.merged_parts(spark, path, "part", "id")


def test_files(spark, tmp_path):
    (tmp_path / "c.csv").write_text("a,b\n1,x\noops,y\n3,z\n")
    assert rows(files.csv(spark, str(tmp_path / "c.csv"), "a int, b string")) == [(1, "x"), (3, "z")]
    assert rows(files.refused_csv(spark, str(tmp_path / "c.csv"), "a int, b string")) == [(None, "y", "oops,y", "c.csv")]
    df = spark.createDataFrame([(2, 'q"\\'), (1, None)], "k int, v string")
    files.to_parquet(df, str(tmp_path / "deep/in/side"), ["k"])
    assert rows(files.recursive(spark, str(tmp_path / "deep"), df.schema)) == rows(df)
    files.to_csv(df.select("k", T.pg_array(F.array("v", F.lit("w"))).alias("v")), str(tmp_path / "out"), "gzip")
    assert list((tmp_path / "out").glob("*.csv.gz"))
    got = spark.read.option("header", True).option("escape", "\\").csv(str(tmp_path / "out"))
    assert rows(got)[0] == ("1", '{NULL,"w"}')
    for name, body in (("1.json", '[{"id":1,"v":"a"},{"id":2,"v":"b"}]'), ("2.json", '[{"id":1,"v":"c"}]')):
        (tmp_path / name).write_text(body)
    pick = lambda keep: rows(files.json_arrays(spark, str(tmp_path / "*.json"), "id int, v string", "id", keep))
    assert pick("last") == [(1, "c"), (2, "b")] and pick("first") == [(1, "a"), (2, "b")]
    assert rows(files.missing_parts(df, df.where("k = 1"), "k")) == [(2,)]


def test_empty_tables_and_unknown_keys(spark):
    none = spark.createDataFrame([], "id int, h string, score double")
    assert sampling.draw(none, "id", "s", ["h"], 3).count() == 0 and sampling.chunks(none, "id", "s", 2).count() == 0
    assert S.quota_flags(none, "score", "id", 0.5, ["h"]).count() == 0
    some = spark.createDataFrame([(1, None), (2, None), (3, "x")], "id int, h string")
    assert rows(sampling.draw(some, "id", "s", ["h"], 5).select("id"))[-1] == (3,)
    chunks = sampling.chunks(spark.range(1000).withColumnRenamed("id", "i"), "i", "s", 30).groupBy("chunk").count()
    assert sorted(r["count"] for r in chunks.collect()) == [10] + [30] * 33
    m = spark.createDataFrame([(1, 1), (1, 2), (None, 1), (2, None)], "work int, who int")
    assert rows(network.edges(m.dropna(), "work", "who", 5)) == [(1, 2, 1)] and network.edges(m.limit(0), "work", "who", 5).count() == 0


def test_whole_words_and_terms(spark):
    df = spark.createDataFrame([("a c++ b",), ("accc",), ("(x)",)], "t string")
    assert [r[0] for r in df.select(T.bounded_lexicon(F.col("t"), ["c++", "(x)"])).collect()] == [True, False, True]


def test_exact_interval_by_its_tails():
    for k, n in ((0, 10), (3, 10), (10, 10), (40, 400)):
        low, high = stats.exact_interval(k, n)
        upper = lambda p, k=k, n=n: math.fsum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1))
        assert low == 0 if k == 0 else upper(low) == pytest.approx(0.025, abs=1e-9)
        assert high == 1 if k == n else 1 - upper(high) + math.comb(n, k) * high**k * (1 - high) ** (n - k) == pytest.approx(0.025, abs=1e-9)
    assert stats.chi_square_p(3.841459) == pytest.approx(0.05, abs=1e-6)


def test_recall_intervals(spark):
    from framelens.plans import agreement
    from tests.conftest import SF

    for r in agreement.recall_intervals(spark, SF).collect():
        low, high = stats.exact_interval(r["tp"], r["n"]) if r["n"] else (None, None)
        assert (r["low"], r["high"]) == (low and round(low, 6), high and round(high, 6))


def test_windows(spark):
    e = spark.createDataFrame([("2024-01-01 00:10:00", "a"), ("2024-01-01 00:50:00", "a"), ("2024-01-01 01:00:00", "a")], "t string, kind string").withColumn("t", F.to_timestamp("t"))
    assert sorted(r["n"] for r in windowed_counts(e, "t", "kind").collect()) == [1, 2]
