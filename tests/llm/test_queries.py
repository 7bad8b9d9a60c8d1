import pytest

from corvane.llm.queries import ORACLE_SQL, QUERIES
from tests.test_queries import compare


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, sf, name):
    compare(spark, sf, QUERIES[name], ORACLE_SQL[name])


def test_ten_operators():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
