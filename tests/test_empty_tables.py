import pytest

from blockloom import registry
from tests import empty


@pytest.fixture(scope="module")
def nothing(spark, root, tmp_path_factory):
    return empty.write(spark, root, str(tmp_path_factory.mktemp("empty")))


#: The budget of an empty range has one row without a block.
OTHERWISE = {"budget_first_block"}


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - OTHERWISE))
def test_every_query_bears_empty_tables(spark, nothing, name):
    assert registry.QUERIES[name](spark, nothing).count() == 0
