"""Order-free comparison of a Spark result with a SQL result."""

import pandas as pd


def _cell(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return "~"
    kind = type(v).__name__
    if isinstance(v, bool) or kind == "bool_" or kind == "bool":
        return str(bool(v))
    if "int" in kind or "float" in kind or kind == "Decimal":
        return f"{float(v):.6f}"
    return str(v)


def same(got: pd.DataFrame, want: pd.DataFrame) -> None:
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    rows = [sorted(tuple(map(_cell, r)) for r in t[cols].itertuples(index=False)) for t in (got, want)]
    assert len(rows[0]) == len(rows[1])
    assert rows[0] == rows[1]
