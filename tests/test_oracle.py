"""Every registered query against its SQL twin on the same Parquet files."""

import pytest
from compare import differences

from sensorloom.plans.catalog import ORACLE, QUERIES

def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, con, folder, name):
    assert differences(QUERIES[name](spark, folder), con, ORACLE[name]) == []
