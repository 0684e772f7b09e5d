import pytest

from glimmer.llm import queries
from tests.oracle import assert_same


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    assert_same(spark, "/root/testdata/sf0.01", queries.queries()[name], queries.oracle_sql()[name])


def test_names():
    assert set(queries.oracle_sql()) <= set(queries.queries())
