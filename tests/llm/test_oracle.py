"""Every training-data query against its SQL twin; the others at least run."""

import pytest

from siftlake.llm import registry
from tests.oracle import differences

DIR = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query(spark, name):
    query = registry.queries()[name]
    if name in SQL:
        assert differences(spark, query, SQL[name], DIR) == ""
    else:
        assert query(spark, DIR).count() > 0
