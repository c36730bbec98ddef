"""Every query with SQL gives what the SQL gives."""

import pytest

import compare
from trendloom.plans import decisions, features, footwear, history, market, registry, reports, scoped, trends

PLANS = trends.QUERIES | market.QUERIES | history.QUERIES | registry.QUERIES | scoped.QUERIES | reports.QUERIES | decisions.QUERIES | footwear.QUERIES | features.QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return compare.tables(sf_dir)


@pytest.mark.parametrize("name", sorted(k for k, (_, sql) in PLANS.items() if sql))
def test_query_equals_sql(spark, sf_dir, con, name):
    run, sql = PLANS[name]
    assert compare.differences(run(spark, sf_dir), con, sql) is None


@pytest.mark.parametrize("name", sorted(k for k, (_, sql) in PLANS.items() if not sql))
def test_query_runs(spark, sf_dir, name):
    assert PLANS[name][0](spark, sf_dir).count() > 0


def test_entry_without_llm(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns[0] == "trend"
