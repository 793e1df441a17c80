"""Literal cases with known values, and the traps of three-valued and list semantics."""

import pytest
from pyspark.sql import functions as F

from framelens.functions import nulls as N
from framelens.functions import text as T
from framelens.operators import contracts as C
from framelens.operators import network, sampling, stats
from framelens.operators import scores as S


def one(df):
    return df.first().asDict()


def scored(spark, rows):
    return spark.createDataFrame(rows, "id int, score double, label boolean, w double")


def test_weighted_confusion(spark):
    df = spark.createDataFrame([(True, True, 2.0), (False, True, 1.0), (True, False, 3.0), (False, False, 4.0)], "label boolean, hit boolean, w double")
    c = one(df.agg(*S.confusion(F.col("label"), F.col("hit"), F.col("w"))))
    assert c == {"tp": 2.0, "fp": 1.0, "fn": 3.0, "tn": 4.0}
    assert 5 * c["tp"] / (5 * c["tp"] + 4 * c["fn"] + c["fp"]) == pytest.approx(10 / 23)


def test_thresholds_without_positives(spark):
    df = scored(spark, [(1, 0.25, False, 1.0), (2, 0.75, False, 1.0)])
    low = one(S.best_threshold(df, "score", F.col("label"), F.col("w"), 2.0, True))
    assert (low["threshold"], low["f"]) == (0.25, 0.0)
    high = one(S.best_threshold(df, "score", F.col("label"), F.col("w"), 2.0, False))
    assert high["threshold"] > 1


def test_threshold_ties(spark):
    df = scored(spark, [(1, 0.9, True, 1.0), (2, 0.8, False, 0.0), (3, 0.1, False, 9.0)])
    assert one(S.best_threshold(df, "score", F.col("label"), F.col("w"), 1.0, True))["threshold"] == 0.8
    assert one(S.best_threshold(df, "score", F.col("label"), F.col("w"), 1.0, False))["threshold"] == 0.9


def test_auc_and_ap_with_ties(spark):
    df = scored(spark, [(1, 0.5, True, 1.0), (2, 0.5, False, 1.0), (3, 0.2, False, 1.0)])
    assert one(S.midrank_auc(df, "score", F.col("label"), F.col("w")))["auc"] == pytest.approx(0.75)
    assert one(S.average_precision(df, "score", F.col("label"), F.col("w")))["ap"] == pytest.approx(0.5)


def test_quota_boundary_of_ties(spark):
    df = spark.createDataFrame([(i, "h", 0.5 if i < 8 else 0.1) for i in range(10)], "id int, head string, score double")
    got = [r["id"] for r in S.quota_flags(df, "score", "id", 0.3, ["head"]).where("flag").orderBy("id").collect()]
    assert got == [0, 1, 2]


def test_packed_scores(spark):
    df = spark.createDataFrame([([0.0, 0.5, 1.0],), ([-0.01],), ([1.01],), ([float("nan")],), ([float("inf")],)], "s array<double>")
    assert [r[0] for r in df.select(T.packed_scores(F.col("s"))).collect()] == ["00000080ffff", None, None, None, None]


def test_venue_groups(spark):
    df = spark.createDataFrame([("W1", "  Journal  OF Tests "), ("W2", "journal of tests"), ("W3", None), ("W4", "")], "id string, v string")
    assert [r[0] for r in df.select(T.venue_key(F.col("v"), F.col("id"))).collect()] == ["journal of tests", "journal of tests", "__missing__:W3", "__missing__:W4"]


def test_bounded_lexicon(spark):
    df = spark.createDataFrame([("xCanaday",), ("in Canada.",), ("les MÉTIS",), ("métissage",)], "t string")
    assert [r[0] for r in df.select(T.bounded_lexicon(F.col("t"), ["canada", "métis"])).collect()] == [False, True, True, False]


def test_deinvert(spark):
    cases = [('{"a":[0,2],"b":[1]}', "a b a"), ('{"a":[0],"b":[0]}', "b"), ('{"a":[-1]}', None), ("{}", None), (None, None)]
    df = spark.createDataFrame([(c[0],) for c in cases], "j string")
    assert [r[0] for r in df.select(T.deinvert(F.col("j"))).collect()] == [c[1] for c in cases]


def test_list_membership_with_nulls(spark):
    df = spark.createDataFrame([([1, None],), (None,)], "a array<int>")
    assert [r[0] for r in df.select(N.contains(F.col("a"), 2)).collect()] == [False, None]
    assert [r[0] for r in df.select(N.overlaps(F.col("a"), F.array(F.lit(2)))).collect()] == [False, None]


def test_unknown_is_not_negative(spark):
    df = spark.createDataFrame([(None, True), (True, None), (True, False)], "a boolean, b boolean")
    assert [r[0] for r in df.select(N.both_known(F.col("a"), F.col("b"), F.col("a") | F.col("b"))).collect()] == [None, None, True]
    assert one(df.agg(N.count_true(F.col("a")).alias("n"), F.count_if(N.is_not_true(F.col("b"))).alias("m"))) == {"n": 2, "m": 2}


def test_team_cap(spark):
    rows = [(1, s) for s in range(3)] + [(2, s) for s in range(4)] + [(3, 0)]
    df = spark.createDataFrame(rows, "w int, m int")
    assert network.edges(df, "w", "m", 3).count() == 3
    assert {r["works"] for r in network.edges(df, "w", "m", 4).collect()} == {1, 2}


def test_draw_prefix_and_weights(spark):
    df = spark.range(100).select(F.col("id"), (F.col("id") % 3).alias("s"))
    small, large = ({r["id"] for r in sampling.draw(df, "id", "x", ["s"], n).collect()} for n in (5, 12))
    assert small < large
    total = sum(r["weight"] for r in sampling.draw(df, "id", "x", ["s"], 5).collect())
    assert total == pytest.approx(100)


def test_exact_intervals():
    low, high = stats.exact_interval(0, 10)
    assert low == 0 and high == pytest.approx(0.3084971, abs=1e-6)
    low, high = stats.exact_interval(7, 20)
    assert (low, high) == pytest.approx((0.1539092, 0.5921885), abs=1e-6)


def test_contract_codes_and_upsert(spark):
    df = spark.createDataFrame([(1, None), (2, 5)], "id int, v int")
    assert [r[0] for r in df.select(C.codes({"low": F.col("v") > 3})).collect()] == [["low"], []]
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 3)], "id int, x string, ver int")
    new = spark.createDataFrame([(1, "c", 1), (2, "d", 2), (3, "e", 1)], "id int, x string, ver int")
    assert {r["id"]: r["x"] for r in C.upsert(old, new, ["id"], "ver").collect()} == {1: "c", 2: "b", 3: "e"}


def test_stream_sync(spark, tmp_path):
    from framelens.streaming.sync import sync

    schema = "k int, v int, at timestamp"
    src, state, ck = str(tmp_path / "in"), str(tmp_path / "state"), str(tmp_path / "ck")
    for rows in ([(1, 10, "2024-01-01"), (2, 20, "2024-01-01")], [(1, 11, "2024-01-02")]):
        spark.createDataFrame(rows, "k int, v int, at string").withColumn("at", F.to_timestamp("at")).write.mode("append").parquet(src)
        sync(spark, src, schema, state, ck, ["k"], ["at"], "at")
    got = spark.read.parquet(f"{state}/v=1").orderBy("k").collect()
    assert [(r["k"], r["v"], str(r["first_seen"])[:10]) for r in got] == [(1, 11, "2024-01-01"), (2, 20, "2024-01-01")]


def test_file_sources(spark, tmp_path):
    from framelens.sources import files

    p = str(tmp_path / "p")
    spark.range(20).withColumn("day", (F.col("id") % 4).cast("string")).write.partitionBy("day").parquet(p)
    assert files.partitioned(spark, p, "day", "1").count() == 10
    (tmp_path / "a.json").write_text('[{"id":1,"x":"a"},{"id":2,"x":"b"}]')
    (tmp_path / "b.json").write_text('[{"id":1,"x":"c"}]')
    got = {r["id"]: r["x"] for r in files.json_arrays(spark, str(tmp_path / "*.json"), "id int, x string", "id").collect()}
    assert got == {1: "c", 2: "b"}
    (tmp_path / "s.xml").write_text("<r><row><id>1</id></row><row><id>2</id></row></r>")
    assert files.xml(spark, str(tmp_path / "s.xml"), "row", "id int").count() == 2
    files.to_csv(spark.range(3), str(tmp_path / "c"), "gzip")
    assert files.csv(spark, str(tmp_path / "c"), "id long").count() == 3
