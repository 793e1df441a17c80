"""Versions on disk, look-up files, harvests, folds, exact tests and published forms on literal cases."""

import itertools
import math
import random
import threading

import pytest
from pyspark.sql import functions as F

from framelens.functions import text as T
from framelens.operators import contracts as C
from framelens.operators import sampling, search, stats
from framelens.sources import harvest, versions, workspace


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_versions(spark, tmp_path):
    root = str(tmp_path / "t")
    one, two = spark.range(5).withColumn("v", F.lit("x")), spark.range(3).withColumn("v", F.lit("y"))
    with pytest.raises(versions.LoadRefused, match="no active"):
        versions.read(spark, root)
    assert versions.publish(one, root, "a", 5, "d1")["sequence"] == 1
    # a load with the wrong number of rows, one that fails midway, one of other contents: the old version stays
    broken = spark.range(0, 1000, 1, 4).select("id", F.when(F.col("id") > 900, F.raise_error(F.lit("midway"))).otherwise("z").cast("string").alias("v"))
    for bad, n, digest in ((two, 4, None), (broken, 1000, None)):
        with pytest.raises(Exception, match="announced|midway"):
            versions.publish(bad, root, "b", n, digest)
        assert versions.active(spark, root)["version"] == "a" and versions.read(spark, root).count() == 5
    with pytest.raises(versions.LoadRefused, match="another digest"):
        versions.publish(two, root, "a", 3, "d2")
    with pytest.raises(versions.LoadRefused, match="name"):
        versions.publish(two, root, "a/b", 3)
    with pytest.raises(versions.LoadRefused, match="columns"):
        versions.publish(two.withColumn("load", F.lit(1)), root, "c", 3)
    # the same version again, by the same digest, replaces its rows
    assert versions.publish(two, root, "a", 3, "d1")["sequence"] == 2
    assert rows(versions.read(spark, root)) == [(0, "y", "a"), (1, "y", "a"), (2, "y", "a")]
    assert versions.publish(one.limit(0), root, "empty", 0)["rows"] == 0 and versions.read(spark, root).count() == 0
    assert versions.roll_back(spark, root, 1) and versions.read(spark, root).count() == 5
    assert [h["version"] for h in versions.history(spark, root)] == ["a", "a", "empty", "a"]
    assert versions.cleaned(spark, root) == 2 and versions.read(spark, root).count() == 5


def test_two_writers(spark, tmp_path):
    root = str(tmp_path / "t")
    versions.publish(spark.range(1), root, "v0", 1)
    staged = [versions.stage(spark.range(k + 2), root, f"w{k}", k + 2) for k in range(4)]
    won = []
    threads = [threading.Thread(target=lambda s=s: won.append((versions.activate(spark, root, s, 1), s["version"]))) for s in staged]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    winners = [v for ok, v in won if ok]
    assert len(winners) == 1 and versions.active(spark, root)["version"] == winners[0] and versions.active(spark, root)["sequence"] == 2


def test_trigrams(spark, tmp_path):
    rng = random.Random(1)
    names = [None, "", "ab", "ABC", "a%c_d", "back\\slash", "naïve Ünit", "xabcx", "abc" * 50] + ["".join(rng.choice("abcd ") for _ in range(rng.randint(0, 20))) for _ in range(400)]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)] + [(3, "ABC")], "k int, name string")
    path = str(tmp_path / "g")
    search.write_postings(df, "k", "name", path, files=4)
    for p in ("%abc%", "ABC", "%b_c%", "%", "ab%", r"%a\%c%", "%ÜNIT%", "%zzz%", r"%k\\s%", "_", "%abcabca%d"):
        assert rows(search.search(df, "k", "name", path, p)) == rows(df.where(F.col("name").ilike(p))), p
    assert search.literal_runs(r"%ab\%c_d%") == ["ab%c", "d"] and search.literal_runs("%%") == []


def test_searches_skip(spark, tmp_path):
    df = spark.range(60_000).select(F.col("id").alias("k"), F.md5(F.col("id").cast("string")).alias("name"))
    path = str(tmp_path / "g")
    search.write_postings(df, "k", "name", path, files=32, group_bytes=64 << 10)
    known = spark.read.parquet(f"{path}/postings")
    found = known.where("gram = 'a0f'")
    got = found.collect()
    read = search.scanned(found)["numOutputRows"]
    assert 0 < len(got) <= read < known.count() / 10
    search.write_facets(df, "name", f"{path}-f", files=16, group_bytes=64 << 10)
    some = search.facets_like(spark, f"{path}-f", "A0", 1000)
    assert {r["value"] for r in some.collect()} == {r["name"] for r in df.where("startswith(name, 'a0')").collect()}
    assert search.scanned(some)["numOutputRows"] < 60_000 / 4


def test_harvest(spark):
    page = lambda ids, token=None: "<OAI-PMH><ListRecords>" + "".join(f"<record><header><identifier>{i}</identifier><datestamp>{d}</datestamp></header></record>" for i, d in ids) + (f"<resumptionToken> {token} </resumptionToken>" if token else "<resumptionToken/>") + "</ListRecords></OAI-PMH>"
    data = [("long", None if i == 0 else f"t/{i}", 1, page([(f"r{i}", "2020"), ("same", f"20{i:02d}")], f"t/{i + 1}" if i < 36 else None)) for i in range(37)]
    data += [("gap", None, 1, page([("a", "1")], "x")), ("gap", "y", 1, page([("b", "1")]))]
    data += [("loop", None, 1, page([("a", "1")], "p")), ("loop", "p", 1, page([("b", "1")], "q")), ("loop", "q", 1, page([("c", "1")], "p")), ("self", None, 1, page([], "s")), ("self", "s", 1, page([("z", "1")], "s"))]
    data += [("twice", None, 1, page([("old", "1")], "n")), ("twice", None, 2, page([("new", "1")])), ("broken", None, 1, "not <xml"), ("lost", "k", 1, page([("a", "1")]))]
    df = harvest.parsed(spark.createDataFrame(data, "chain string, token string, retrieved int, xml string").repartition(3), F.col("xml"))
    places = harvest.placed(df, spark)
    got = {r["chain"]: tuple(r)[1:] for r in harvest.report(df, places).collect()}
    assert got == {
        "long": (37, 37, 0, None, None, 74, 36), "gap": (2, 1, 1, "x", None, 1, 0), "loop": (3, 3, 0, None, "p", 3, 0), "self": (2, 2, 0, None, "s", 1, 0), "twice": (1, 1, 0, None, None, 1, 0),
        "broken": (1, 1, 0, None, None, 0, 0), "lost": (1, 0, 1, None, None, 0, 0),
    }
    assert [r["place"] for r in places.where("chain = 'long'").orderBy("place").collect()] == list(range(37))
    last = harvest.latest(harvest.records(df, places)).where("identifier = 'same'").first()
    assert (last["datestamp"], last["place"]) == ("2036", 36)
    assert harvest.report(df.limit(0), harvest.placed(df.limit(0), spark)).count() == 0


def greedy(sizes, k):
    load = [0] * k
    for s in sorted(sizes, reverse=True):
        load[load.index(min(load))] += s
    return load


def test_dealt_counts():
    rng = random.Random(4)
    for _ in range(300):
        k, sizes = rng.randint(1, 7), [rng.choice([1, 1, 1, 2, 3, 7, 50]) for _ in range(rng.randint(0, 60))]
        got = sampling.dealt_counts([(s, sizes.count(s)) for s in set(sizes)], k)
        assert [sum(s * n[f] for s, n in got.items()) for f in range(k)] == greedy(sizes, k)
    many = sampling.dealt_counts([(1, 10**12), (10**11, 3)], 5)
    assert sum(many[1]) == 10**12 and max(many[1]) - min(many[1]) == 10**11


def test_balanced_folds(spark):
    data = [(i, f"g{i % 7}" if i % 3 else [None, "", "  "][i % 9 // 3]) for i in range(200)] + [(i, "big") for i in range(200, 260)]
    out = sampling.balanced_folds(spark.createDataFrame(data, "id int, venue string"), "venue", "id", 4)
    assert out.count() == 260 and out.columns == ["id", "venue", "fold"]
    named = out.where("trim(venue) <> ''").groupBy("venue").agg(F.count_distinct("fold").alias("n")).collect()
    assert all(r["n"] == 1 for r in named)
    sizes = [r["count"] for r in out.where("trim(venue) <> ''").groupBy("venue").count().collect()] + [1] * out.where("venue IS NULL OR trim(venue) = ''").count()
    assert sorted(r["count"] for r in out.groupBy("fold").count().collect()) == sorted(greedy(sizes, 4))
    assert sampling.balanced_folds(out.limit(0).drop("fold"), "venue", "id", 3).count() == 0
    with pytest.raises(ValueError, match="fold"):
        sampling.balanced_folds(out, "venue", "id", 0)


def test_exact_permutations():
    def chance(n, m, d, x):
        return math.comb(m, x) * math.comb(n - m, d - x) / math.comb(n, d)

    strata = [(12, 5, 4), (9, 0, 3), (20, 11, 13), (1, 1, 1), (0, 0, 0)]
    spans = [[(x, chance(*s, x)) for x in range(max(0, s[1] + s[2] - s[0]), min(s[1], s[2]) + 1)] for s in strata]
    whole = {}
    for each in itertools.product(*spans):
        x = sum(e[0] for e in each)
        whole[x] = whole.get(x, 0) + math.prod(e[1] for e in each)
    for x in range(20):
        assert stats.reached(strata, x) == pytest.approx(sum(p for y, p in whole.items() if y >= x), abs=1e-12)
        n, m, d = (sum(s[i] for s in strata) for i in range(3))
        assert stats.as_far(strata, x) == pytest.approx(sum(p for y, p in whole.items() if abs(y * n - m * d) >= abs(x * n - m * d)), abs=1e-12)
    assert stats.as_far([], 0) == 1.0 and stats.reached([(10**7, 10**6, 5 * 10**6)], 500_000) == pytest.approx(0.5, abs=0.001)


def test_chi_square_tail(spark):
    got = [r[0] for r in spark.createDataFrame([(3.841459,), (0.0,), (None,), (50.0,)], "x double").select(stats.chi_square_tail("x")).collect()]
    assert got[0] == pytest.approx(0.05, abs=1e-6) and got[1] == 1.0 and got[2] is None and got[3] < 1e-11


def test_published_forms(spark):
    import json

    texts = ['q"\\ \n\t\u0001\u000b\u001f é\U0001f600 /', r"\u000B \\u000B", "", None]
    df = spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "t string, i int")
    c = T.canonical_json({"z": F.col("t"), "a": {"n": F.col("i"), "b": F.array("i", F.lit(2))}, "flag": F.lit(True)})
    want = [json.dumps({k: v for k, v in {"z": t, "a": {"n": i, "b": [i, 2]}, "flag": True}.items() if v is not None}, ensure_ascii=False, sort_keys=True, separators=(",", ":")) for i, t in enumerate(texts)]
    assert [r[0] for r in df.select(c).collect()] == want
    assert T.prefixed(df, ["i"], "arm").columns == ["i", "arm_t"]
    assert [(r["i"], r["column"]) for r in C.missing(df, ["t", "i"]).collect()] == [(3, "t")]


def test_order_over_files(spark, tmp_path):
    from framelens.sources import files

    path = str(tmp_path / "o")
    files.to_parquet(spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"), "id").repartition(6), path, ["k"])
    bounds = spark.read.parquet(path).groupBy(F.input_file_name().alias("f")).agg(F.min("k").alias("low"), F.max("k").alias("high")).orderBy("f").collect()
    assert all(a["high"] < b["low"] for a, b in itertools.pairwise(bounds))
    import pyarrow.parquet as pq

    for f in sorted((tmp_path / "o").glob("*.parquet")):
        k = pq.read_table(f).column("k").to_pylist()
        assert k == sorted(k)


def test_workspace(spark, tmp_path):
    df = workspace.written(spark.range(3), str(tmp_path / "w"))
    assert df.count() == 3 and workspace.shared_dir(spark)
    workspace.removed(spark, str(tmp_path / "w"))
    assert not (tmp_path / "w").exists()


def test_malformed_lines_whichever_columns_are_read(spark, tmp_path):
    from framelens.sources import files

    (tmp_path / "c.csv").write_text("a,b\n1,x\noops,y\n3,z\n")
    path = str(tmp_path / "c.csv")
    assert files.csv(spark, path, "a int, b string").select("b").count() == 2
    assert rows(files.refused_csv(spark, path, "a int, b string").select("b")) == [("y",)]
