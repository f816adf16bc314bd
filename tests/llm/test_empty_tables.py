import pytest

from blockloom.llm import queries
from tests import empty


@pytest.fixture(scope="module")
def nothing(spark, root, tmp_path_factory):
    return empty.write(spark, root, str(tmp_path_factory.mktemp("empty")))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_every_query_bears_empty_tables(spark, nothing, name):
    rows = queries.QUERIES[name](spark, nothing).collect()
    assert [tuple(r) for r in rows] == ([(0, 0, 0, 0)] if name == "p9_fill_check" else [])
