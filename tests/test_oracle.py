"""Every registered query against its SQL in DuckDB, over the whole smallest tables."""

import pytest
from compare import connect, differences
from conftest import SMALL

from lodestone.registry import ORACLE, QUERIES


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, con, name):
    found = differences(QUERIES[name](spark, SMALL), con, ORACLE[name])
    assert [f for f in found if f != "no rows"] == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
