import pytest

from tidegrid.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, compare, name):
    ours, theirs = compare(spark, registry.queries()[name], registry.oracle_sql()[name], SF)
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_flagship_has_rows(spark):
    assert registry.flagship(spark, SF).limit(1).count() == 1
