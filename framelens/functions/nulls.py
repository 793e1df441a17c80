"""Three-valued logic helpers: unknown is neither true nor false until it is said to be."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def known_true(p: Column) -> Column:
    return F.coalesce(p, F.lit(False))


def is_not_true(p: Column) -> Column:
    """FALSE or unknown."""
    return ~F.coalesce(p, F.lit(False))


def contains(a: Column, value) -> Column:
    """Membership that is false, not unknown, where the list holds a null; unknown only for an unknown list."""
    return F.when(a.isNotNull(), F.coalesce(F.array_contains(a, value), F.lit(False)))


def overlaps(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.coalesce(F.arrays_overlap(a, b), F.lit(False)))


def both_known(a: Column, b: Column, value: Column) -> Column:
    """value where both inputs are known, else unknown."""
    return F.when(a.isNotNull() & b.isNotNull(), value)


def count_true(p: Column) -> Column:
    """Rows where p is true; 0 on no rows."""
    return F.coalesce(F.sum(known_true(p).cast("long")), F.lit(0).cast("long"))
