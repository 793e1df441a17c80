"""Every registered query of the engine against its SQL, on the smallest tables."""

import pytest

from framelens.plans import catalog
from tests.compare import same
from tests.conftest import SF, over

QUERIES, ORACLE = catalog.queries(), catalog.oracle_sql()
LARGER = SF.replace("sf0.001", "sf0.01")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLE:
        same(got, duck.sql(ORACLE[name]).df())
    if not len(got):
        # the smallest tables have no such rows: the next larger ones must
        got = QUERIES[name](spark, LARGER).toPandas()
        assert len(got) > 0
        if name in ORACLE:
            same(got, over(LARGER).sql(ORACLE[name]).df())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["source", "target", "works"]
    assert set(e.oracle_sql()) <= set(e.queries())
