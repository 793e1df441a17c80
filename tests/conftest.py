import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from framelens.session import build_session

    return build_session("tests", cpus=4)


def over(folder):
    """A DuckDB connection with a view for each table of a folder."""
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(folder):
        if f.endswith(".parquet") and os.path.isfile(f"{folder}/{f}"):
            con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{folder}/{f}')")
    return con


@pytest.fixture(scope="session")
def duck():
    return over(SF)
