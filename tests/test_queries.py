"""Every registered query runs; those with SQL give the same rows as DuckDB."""

import pytest

from tests.oracle import both, database
from tessera import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return database(SF)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    if name in catalog.ORACLE_SQL:
        mine, theirs = both(df, con, catalog.ORACLE_SQL[name])
        assert mine == theirs
    else:
        rows = df.collect()
        assert rows and len(df.columns) == len(set(df.columns))
