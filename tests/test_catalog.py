"""Every query with SQL is compared with DuckDB, in names, types and values."""

import pytest

import __spark_entry__ as entry
from oracle.compare import connect, differences
from tests.conftest import SMALL

ORACLE = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


def test_every_sql_belongs_to_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, duck, name):
    assert differences(QUERIES[name](spark, SMALL), duck, ORACLE[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_sql_returns_rows(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 5


@pytest.mark.parametrize("name", ["b1_health_categories", "g13_cohort_summary", "h7_category_summary"])
def test_reports_read_few_columns(spark, name):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    schema = plan.split("ReadSchema: struct<")[1].split(">")[0]
    assert len(schema.split(",")) < 20


def test_filters_reach_the_scan(spark):
    from churnloom.operators import reports
    from churnloom.plans.mart import mart_for

    plan = reports.customer_profile(mart_for(spark, SMALL).scored, 50003)
    assert "EqualTo(CustomerID,50003)" in plan._jdf.queryExecution().executedPlan().toString()
