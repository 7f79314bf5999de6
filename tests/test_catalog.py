"""Every registered query against its SQL on the smallest tables, and what the registry promises."""

import pytest

from areapanel.catalog import CATALOG
from oracle import compare, connect


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", [n for n, q in CATALOG.items() if q.sql])
def test_equals_sql(spark, sf, con, name):
    q = CATALOG[name]
    assert compare(q.run(spark, sf), con, q.sql) is None


@pytest.mark.parametrize("name", [n for n, q in CATALOG.items() if not q.sql])
def test_repeats_itself(spark, sf, name):
    q = CATALOG[name]
    first, second = (sorted(map(str, q.run(spark, sf).collect())) for _ in range(2))
    assert first and first == second


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["area", "name", "growth", "n", "adjacent_n", "rank"]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_top_k_is_not_a_sort(spark, sf):
    plan = CATALOG["top_ten"].run(spark, sf)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan


def test_first_row_per_key_is_limited_before_the_shuffle(spark, sf):
    plan = CATALOG["dedupe_first"].run(spark, sf)._jdf.queryExecution().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_filters_and_columns_reach_the_scan(spark, sf):
    df = CATALOG["category_and_year_filters"].run(spark, sf)
    plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    pushed = next(line for line in plan.splitlines() if "PushedFilters" in line)
    assert "o_orderpriority" in pushed and "o_orderstatus" in pushed and "o_orderdate" in pushed, pushed
    assert "o_totalprice" not in plan


def test_no_cross_join_anywhere(spark, sf):
    for name in ("complete_grid", "neighbor_average", "nearest_top_member", "score_over_draws", "histogram_all", "rows_for_future_years"):
        plan = CATALOG[name].run(spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_forest_queries_fit_the_whole_forest(spark, sf, monkeypatch):
    import inspect

    from areapanel.operators import models

    class Fitted(Exception):
        pass

    signature = inspect.signature(models.fit_forest)

    def fit_forest(*args, **how):
        given = signature.bind(*args, **how)
        given.apply_defaults()
        raise Fitted(given.arguments["trees"], given.arguments["depth"])

    monkeypatch.setattr(models, "fit_forest", fit_forest)
    for name in ("forest_importances", "forest_test_metrics"):
        with pytest.raises(Fitted) as found:
            CATALOG[name].run(spark, sf)
        assert found.value.args == (500, 8)
