import pytest
from oracle import DATA, check

from factweave.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    if name in SQL:
        check(spark, QUERIES[name], SQL[name])
    else:
        assert QUERIES[name](spark, DATA).count() >= 0
