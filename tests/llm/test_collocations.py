"""Perfect hashes, and collocations against a plain count of all phrases: rounds, ties, overlaps, odd words, the registered SQL."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tests.compare import same
from tests.conftest import SF, over

SCHEMA = "doc_id long, text string, lang string, score int, pair string"


@pytest.mark.parametrize("n", [0, 1, 2, 63, 5000, 200_000])
def test_perfect_hash(n):
    from framelens.llm.perfect_hash import PerfectHash

    rng = np.random.default_rng(n)
    keys = np.unique(np.concatenate([rng.integers(0, 2**63, n // 2, np.int64), np.arange(n - n // 2)]).astype(np.uint64))
    h = PerfectHash(keys)
    assert sorted(h.slots(keys).tolist()) == list(range(len(keys)))
    assert (h.keys[h.slots(keys)] == keys).all() if len(keys) else len(h) == 0
    others = np.setdiff1d(rng.integers(0, 2**63, 5000, np.int64).astype(np.uint64), keys)
    assert (h.slots(others) == -1).all()


def plain(rows, least, longest=5, top=2000, scale=1000, cover=100):
    counts, totals = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", t):
            w = tuple(re.findall(r"[^\x20\x09]+", piece))
            totals[lang] += len(w)
            counts.update((lang, w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    cands = {p: a for p, a in counts.items() if a >= least and len(p[1]) > 1}
    gone = set()
    for (lang, w), f in cands.items():
        gone |= {(lang, w[i : i + k]) for k in range(2, len(w)) for i in range(len(w) - k + 1) if 100 * f >= cover * counts[lang, w[i : i + k]]}
    out = {}
    for (lang, w), a in cands.items():
        if (lang, w) not in gone:
            cuts = [(scale * a * totals[lang] // (counts[lang, w[:m]] * counts[lang, w[m:]]), m) for m in range(1, len(w))]
            score, m = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), counts[lang, w[:m]], counts[lang, w[m:]]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, totals[lang], -s) for lang, ps in out.items() for i, (s, a, p, left, right) in enumerate(sorted(ps)[:top]))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    vocab = ["the", "The", "a", "É", "é", "x\x1cy", "-", "'", " ", "\x00", "w" * 300, "v" * 300, "\U0001f600", "new", "york", "city"]
    out = []
    for i in range(300):
        w = [rng.choice(vocab[: rng.choice([3, 8, 16])]) for _ in range(rng.randint(0, 60))]
        w += rng.choice([["new", "York", "city"], ["New\tyork  city", "hall."], ["of,", "the"], ["a"] * 7])
        out.append((i % 90, rng.choice([" ", "  ", "\t", " "]).join(w) + rng.choice([". ", "\r\n", "?x", ""]), rng.choice(["en", "en", "fr", None, "und", "a\tb", ""]), 1, "clash"))
    return out + [(None, None, "en", 1, "clash"), (1, "", None, 1, "clash"), (2, " \t", "de", 1, "clash"), (3, "new york " * 120_000, "long", 1, "clash")]


@pytest.mark.parametrize(("size", "sieve", "least", "cover"), [(1 << 21, 1 << 22, 5, 100), (40, 1 << 16, 9, 60)])
def test_against_a_plain_count(spark, rows, size, sieve, least, cover):
    from framelens.llm.collocations import collocations

    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted(tuple(r) for r in collocations(df, least=least, cover=cover, size=size, sieve=sieve).collect())
    assert got == plain(rows, least, cover=cover) and len(got) > 20


def test_best_of_each_language(spark, rows):
    from framelens.llm.collocations import collocations

    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(tuple(r) for r in collocations(df, least=4, longest=3, top=6).collect()) == plain(rows, 4, longest=3, top=6)


def test_none(spark, rows):
    from framelens.llm.collocations import collocations

    df = spark.createDataFrame(rows, SCHEMA)
    assert collocations(df.limit(0)).count() == 0
    assert collocations(df.where("lang = 'de'")).count() == 0
    assert collocations(spark.createDataFrame([(1, "a b. a c. a", "en")], "doc_id long, text string, lang string"), least=2).count() == 0


def test_large_counts_are_exact(spark):
    from framelens.llm.collocations import _scored

    big = 4 * 10**15
    df = spark.createDataFrame([("en", "p q r", [big, big - 1, big - 3], [big - 2, big - 1, big - 3], big - 3, big)], "lang string, text string, starts array<long>, ends array<long>, f long, n long")
    r = _scored(df, 1000).first()
    want = min((1000 * (big - 3) * big // (left * right), m) for m, (left, right) in enumerate([(big, big - 1), (big - 1, big - 2)]))
    assert r["score"] == want[0]


def test_sums_in_a_tree(spark, monkeypatch):
    from framelens.llm import collocations as C

    monkeypatch.setattr(C, "FAN", 3)
    monkeypatch.setattr(C, "CHUNK", 1000)
    rng = np.random.default_rng(0)
    parts = rng.integers(0, 300, (20, 2005))
    rows = [(c, b, "<i8", C.packed(parts[b, c * C.CHUNK : (c + 1) * C.CHUNK].astype("<i8"))) for b in range(20) for c in range(-(-parts.shape[1] // C.CHUNK))]
    df = spark.createDataFrame([(*r[:3], bytearray(r[3])) for r in rows], C.ARRAYS).repartition(9)
    assert (C.tree_sum(df, parts.shape[1]) == parts.sum(0)).all()
    assert (C.tree_sum(df, parts.shape[1], 700) == np.minimum(parts.sum(0), 700)).all()


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_sql(spark, sf):
    from framelens.llm import queries

    folder = SF.replace("sf0.001", sf)
    same(queries.op13_collocations(spark, folder).toPandas(), over(folder).sql(queries.ORACLE["op13_collocations"]).df())
