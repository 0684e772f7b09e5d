import pytest

from glimmer import registry
from tests.oracle import assert_same

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, name):
    assert assert_same(spark, SF, registry.queries()[name], registry.oracle_sql()[name]) > 0
