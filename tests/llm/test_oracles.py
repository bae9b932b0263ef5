import pytest

from loomgraph.llm import registry

from ..oracle import differences

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(spark, name):
    assert differences(registry.queries()[name](spark, SF), registry.oracle_sql()[name], SF) == ""
