"""Every registered query of the core against its SQL, at the smallest scale."""

import pytest
from conftest import SMALL
from oracle import same

from helmsway.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SMALL).toPandas()
    if name in SQL:
        assert same(got, duck.sql(SQL[name]).df()) == ""


def test_all_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_no_plan_compares_all_with_all(spark):
    for name in ("pair_stale", "asof_seq", "neighbour_pairs", "persistence", "p5_found"):
        plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name
