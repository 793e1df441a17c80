"""Exact intervals and tests from aggregated counts."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


def _tail(k: int, n: int, p: float) -> float:
    """P(X >= k), X ~ Binomial(n, p)."""
    if k <= 0:
        return 1.0
    if p <= 0:
        return 0.0
    if p >= 1:
        return 1.0
    out = 0.0
    for i in range(k, n + 1):
        out += math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p))
    return min(1.0, out)


def _solve(f, target: float) -> float:
    lo, hi = 0.0, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < target else (lo, mid)
    return (lo + hi) / 2


def exact_interval(k: int, n: int, level: float = 0.95) -> tuple[float, float]:
    """Clopper-Pearson interval."""
    a = (1 - level) / 2
    low = 0.0 if k == 0 else _solve(lambda p: _tail(k, n, p), a)
    high = 1.0 if k == n else _solve(lambda p: _tail(k + 1, n, p), 1 - a)
    return low, high


@F.pandas_udf(StructType([StructField("low", DoubleType()), StructField("high", DoubleType())]))
def clopper_pearson(k: pd.Series, n: pd.Series) -> pd.DataFrame:
    """For aggregated counts: one row a group."""
    return pd.DataFrame([exact_interval(int(a), int(b)) if b else (None, None) for a, b in zip(k, n, strict=True)], columns=["low", "high"])


def kappa(agree: Column, expected: Column, n: Column) -> Column:
    """Cohen's kappa from n, agreeing rows and the sum of products of the margins; null if agreement is certain."""
    po, pe = agree / n, expected / (n * n)
    return F.when(pe != 1, (po - pe) / (1 - pe))


def hypergeometric(total: int, marked: int, drawn: int) -> tuple[int, np.ndarray]:
    """The smallest number of marked ones among the drawn, and the chance of each number from there on. Where the chance is below 1e-30 it is left out, so a stratum of n
    rows takes some square roots of n numbers."""
    low, high = max(0, drawn + marked - total), min(drawn, marked)
    mode = min(max((drawn + 1) * (marked + 1) // (total + 2), low), high)
    # the ratio of neighbouring chances, walked both ways from the largest
    up, down = [1.0], []
    for x in range(mode, high):
        up.append(up[-1] * (marked - x) * (drawn - x) / ((x + 1) * (total - marked - drawn + x + 1)))
        if up[-1] < 1e-30:
            break
    now = 1.0
    for x in range(mode, low, -1):
        now *= x * (total - marked - drawn + x) / ((marked - x + 1) * (drawn - x + 1))
        down.append(now)
        if now < 1e-30:
            break
    chances = np.array([*reversed(down), *up])
    return mode - len(down), chances / chances.sum()


def shuffled(strata: list[tuple[int, int, int]]) -> tuple[int, np.ndarray]:
    """The same for the sum over strata of (rows, marked, drawn): what shuffling the marks within strata gives, all shuffles being equally likely. Strata are
    convolved, smallest first."""
    at, chances = 0, np.ones(1)
    parts = sorted((hypergeometric(*s) for s in strata), key=lambda p: len(p[1]))
    for low, part in parts:
        at, chances = at + low, np.convolve(chances, part)
    return at, chances


def reached(strata: list[tuple[int, int, int]], observed: int) -> float:
    """The chance of at least so many."""
    at, chances = shuffled(strata)
    return float(min(1.0, chances[max(0, observed - at) :].sum()))


def as_far(strata: list[tuple[int, int, int]], observed: int) -> float:
    """The chance of a number as far or farther from what the totals alone would give, on either side: the test of a 2 x 2 statistic, which is the square of that distance
    times a constant."""
    at, chances = shuffled(strata)
    n, marked, drawn = (sum(s[i] for s in strata) for i in range(3))
    if n == 0:
        return 1.0
    far = abs((np.arange(len(chances)) + at) * n - marked * drawn) >= abs(observed * n - marked * drawn)
    return float(min(1.0, chances[far].sum()))


_STRATA = "array<struct<n:bigint,marked:bigint,drawn:bigint,both:bigint>>"


def _over_strata(test):
    def run(strata: pd.Series) -> pd.Series:
        return strata.map(lambda s: test([(int(x["n"]), int(x["marked"]), int(x["drawn"])) for x in s], sum(int(x["both"]) for x in s)))

    return F.pandas_udf(run, DoubleType())


def permutation_reached(strata: Column) -> Column:
    """Exact share of the shuffles within strata that have at least as many rows both marked and drawn. strata: array of (n, marked, drawn, both), counts."""
    return _over_strata(reached)(strata.cast(_STRATA))


def permutation_as_far(strata: Column) -> Column:
    return _over_strata(as_far)(strata.cast(_STRATA))


@F.pandas_udf(DoubleType())
def chi_square_tail(statistic: pd.Series) -> pd.Series:
    """Upper tail for one degree of freedom; null for null."""
    return statistic.map(lambda x: None if x is None or x != x else chi_square_p(max(0.0, x)))


def chi_square_p(statistic: float) -> float:
    """Upper tail for one degree of freedom."""
    return math.erfc(math.sqrt(statistic / 2))
