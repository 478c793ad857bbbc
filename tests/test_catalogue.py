import pytest

from planarix.plans import catalogue, workflows
from tests import oracle

SQL = catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, name):
    oracle.check(spark, sf_dir, catalogue.QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, sf_dir, name):
    rows = catalogue.QUERIES[name](spark, sf_dir).count()
    assert workflows and (rows > 0 or name in ("cluster_shapes", "lymphoid_aggregates"))  # the smallest table has no clusters


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
