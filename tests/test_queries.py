"""Every catalogue query against its SQL on the small tables."""

import pytest
from tests.oracle import compare

from catalogspark.plans.queries import ORACLE, QUERIES


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLE.keys()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, name):
    ours, theirs = compare(spark, name, "/root/testdata/sf0.001")
    assert ours == theirs
