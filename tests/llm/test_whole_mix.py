"""The mix against its real targets from the first slot to the last, for every source."""

import random
from fractions import Fraction

from framelens.llm import mixing as M


def ideal(blocks, weights):
    """Blocks of each source in the ideal mix after each slot."""
    w = {s: Fraction(x) for s, x in weights.items()}
    have = dict.fromkeys(blocks, Fraction(0))
    for _ in range(sum(blocks.values())):
        left = Fraction(1)
        while left:
            on = [s for s in blocks if have[s] < blocks[s] and w[s] > 0] or [s for s in blocks if have[s] < blocks[s]]
            share = {s: w[s] if w[s] > 0 else Fraction(1) for s in on}
            total = sum(share.values())
            step = min(left, *((blocks[s] - have[s]) * total / share[s] for s in on))
            for s in on:
                have[s] += step * share[s] / total
            left -= step
        yield dict(have)


def test_exact_targets():
    rng = random.Random(3)
    for _ in range(12):
        w = {f"s{i}": rng.choice([rng.random() ** 4 + 1e-4, 1.0, 0.0]) for i in range(rng.randint(1, 9))}
        blocks = {s: rng.randint(0, 40) for s in w}
        plan = M.exact_schedule(blocks, w)
        order = sorted((t, s) for s, slots in plan.items() for t in slots)
        assert [t for t, _ in order] == list(range(sum(blocks.values())))
        assert all(list(x) == sorted(x) and len(x) == blocks[s] for s, x in plan.items())
        got = dict.fromkeys(blocks, 0)
        for (_, s), want in zip(order, ideal(blocks, w)):
            got[s] += 1
            assert all(abs(got[x] - want[x]) < 1 for x in got)


def deviation(spark, sizes, targets):
    rows = [(k * 10_000 + i, s) for k, (s, n) in enumerate(sizes.items()) for i in range(n)]
    got = M.mix(spark.createDataFrame(rows, "doc_id long, source string"), targets, block=1).select("slot", "source").collect()
    assert sorted(r["slot"] for r in got) == list(range(len(rows)))
    total, have, worst = sum(sizes.values()), dict.fromkeys(sizes, 0), 0.0
    for t, r in enumerate(sorted(got), 1):
        have[r["source"]] += 1
        worst = max(worst, max(abs(have[s] - n * t / total) for s, n in sizes.items()))
    return worst


def test_equal_sources(spark):
    assert deviation(spark, {f"s{i}": 400 for i in range(20)}, None) < 1


def test_many_sources(spark):
    sizes = {f"s{i}": 5 + i % 37 for i in range(200)}
    assert deviation(spark, sizes, {s: float(n) for s, n in sizes.items()}) < 1
