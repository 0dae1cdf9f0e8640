import pytest

from postlane.plans.catalog import ORACLE_SQL, QUERIES
from tests.compare import differences


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    assert differences(spark, QUERIES[name], ORACLE_SQL[name], "/root/testdata/sf0.001") == []
