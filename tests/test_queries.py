import os

import pytest
from oracle import DATA, compare

from gleanery import registry

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_agrees_with_sql(spark, name):
    compare(registry.queries()[name](spark, DATA), registry.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_runs(spark, name):
    assert registry.queries()[name](spark, DATA).count() >= 0


def test_entry(spark):
    assert registry.flagship(spark, DATA).count() > 0
