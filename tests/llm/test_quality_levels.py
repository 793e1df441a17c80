"""Certified levels: against exact tails, by simulation, and on held-out labels of the larger tables."""

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF


def tail(k, n, p):
    q = Fraction(p).limit_denominator(10**6)
    return sum(math.comb(n, i) * q**i * (1 - q) ** (n - i) for i in range(k + 1))


def plain_level(levels, alpha, bound, count):
    best = None
    for t in range(count):
        if tail(sum(x <= t for x in levels), len(levels), alpha) > bound:
            break
        best = t
    return best


def test_levels_by_exact_tails(spark):
    from framelens.llm import quality_rules as Q

    rng = random.Random(1)
    strata = {"a": [Q.LEVELS] * 84, "b": [Q.LEVELS] * 100, "c": [min(Q.LEVELS, int(rng.expovariate(0.01))) for _ in range(400)], "d": [3] * 300 + [Q.LEVELS] * 9000, "e": [0] * 500, "f": [5], "g": [min(Q.LEVELS, 14 + int(rng.expovariate(0.05))) for _ in range(700)]}
    df = spark.createDataFrame([(s, x) for s, xs in strata.items() for x in xs], "_stratum string, _within int")
    got = {r["_stratum"]: r["_level"] for r in Q.certified_levels(df).collect()}
    able = sum(len(x) >= 59 for x in strata.values())
    assert got == {s: plain_level(x, 0.05, 0.05 / able, Q.LEVELS) for s, x in strata.items()}
    assert got["a"] is None and got["b"] == Q.LEVELS - 1 and got["e"] is None and got["f"] is None and got["d"] == Q.LEVELS - 1
    assert Q.certified_levels(df.limit(0)).count() == 0


def test_guarantee_by_simulation(spark):
    """Of 1,000 draws of labels the level rejects more than ALPHA of all good documents in at most DELTA."""
    from framelens.llm import quality_rules as Q

    rng = random.Random(7)
    share = [0.004 * (t + 1) for t in range(Q.LEVELS)]  # of all good documents, rejected at each level: the fifth part of a percent more each time
    draws = 1000
    levels = [(f"{k}", next((t for t, s in enumerate(share) if u < s), Q.LEVELS)) for k in range(draws) for u in (rng.random() for _ in range(150))]
    got = Q.certified_levels(spark.createDataFrame(levels, "_stratum string, _within int"), delta=Q.DELTA * draws).collect()
    broken = sum(r["_level"] is not None and share[r["_level"]] > Q.ALPHA for r in got)
    assert len(got) == draws and broken <= Q.DELTA * draws and sum(r["_level"] is not None for r in got) > draws / 4


def test_verdicts_by_brute_force(spark):
    from framelens.llm import quality_rules as Q

    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    text = lambda kind: " ".join((word(rng.randint(2, 8)) + ("#" * rng.randint(0, 4) if kind == 1 else "")) if kind != 2 else word(rng.randint(12, 15)) for _ in range(rng.randint(50, 80)))
    docs, labels = [], []
    for i in range(400):
        kind = rng.choice([0, 0, 0, 0, 1, 2])
        docs.append((i, text(kind), "x" if i % 4 else None))
        if i % 3:
            labels += [(i, int(kind == 0))] * (1 + i % 2)
    labels += [(1, None), (docs[0][0], 1), (docs[0][0], 0), (None, 1)]  # contradictory labels make a document bad
    d, lab = spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")
    out = {r["doc_id"]: r for r in Q.quality_verdicts(d, lab).collect()}
    said = {}
    for i, q in labels:
        if q is not None:
            said[i] = min(said.get(i, 1), q)
    grid = {r: Q.cutoffs(r) for r in Q.RULES}

    def ratios(r):
        return {name: (r[top] / r[low] if r[low] else 0.0) for name, (form, _, _) in Q.RULES.items() for top, low in [form.split(" / ")]}

    passed = {i: min(sum(ratios(r)[n] <= c for c in grid[n]) for n in grid) for i, r in out.items()}
    for lang in ("x", None):
        own = [i for i, _, x in docs if x == lang]
        good = [passed[i] for i in own if said.get(i) == 1 and not out[i]["base_failed"]]
        able = sum(sum(said.get(i) == 1 and not out[i]["base_failed"] for i, _, x in docs if x == s) >= 59 for s in ("x", None))
        level = plain_level(good, Q.ALPHA, Q.DELTA / able, Q.LEVELS)
        for i in own:
            want = [] if level is None else [n for n in Q.RULES if ratios(out[i])[n] > grid[n][level]]
            assert out[i]["failed_rules"] == want and out[i]["kept"] == (not out[i]["base_failed"] and not want)
    assert any(r["failed_rules"] for r in out.values())


def test_all_languages_on_held_out_labels(spark):
    """Cutoffs from half of the labels of the larger tables: good documents of the other half are kept, bad ones go."""
    from framelens.llm import quality_rules as Q

    folder = SF.replace("sf0.001", "sf0.1")
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality")
    half = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    out = Q.quality_verdicts(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang"), labels.where(half))
    rest = out.where("NOT base_failed").join(labels.where(~half), "doc_id").groupBy("lang", "quality").agg(F.count("*").alias("n"), F.count_if(~F.col("kept")).alias("gone")).collect()
    got = {(r["lang"], r["quality"]): (r["gone"], r["n"]) for r in rest}
    assert len({lang for lang, _ in got}) == 4
    for (_, quality), (gone, n) in got.items():
        assert gone <= 0.05 * n + 2 if quality else gone >= 0.5 * n


@pytest.mark.parametrize("rule", ["symbols_per_word", "word_length"])
def test_cutoffs_tighten(rule):
    from framelens.llm import quality_rules as Q

    assert Q.cutoffs(rule) == sorted(Q.cutoffs(rule), reverse=True) and len(set(Q.cutoffs(rule))) == Q.LEVELS
