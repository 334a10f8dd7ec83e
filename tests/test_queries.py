"""Every registered query of the engine beside its SQL, on the smallest tables."""

import pytest
from conftest import SF
from oracle import connect, mismatch

from wayloom import catalog


@pytest.fixture(scope="module")
def con():
    return connect(SF)


#: Ten suppliers can't fill the quota of a set, so no start is completed and no whole set is there to swap in.
EMPTY_HERE = ("history_flatten", "swap_improve")


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    if name in catalog.ORACLE_SQL:
        assert mismatch(df, con, catalog.ORACLE_SQL[name]) is None
    else:
        assert df.columns and (df.count() > 0 or name in EMPTY_HERE)


def test_entry(spark):
    import __spark_entry__ as e

    assert set(catalog.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
