import pytest

from tests.oracle import by_duckdb, by_spark
from tidewater.llm.registry import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    assert by_spark(QUERIES[name](spark, FOLDER)) == by_duckdb(FOLDER, ORACLE[name])
