"""Every catalogue query against its DuckDB statement, and plan shapes."""

import pytest

from lumenfold.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, sf, duck, compare, name):
    compare(catalog.queries()[name](spark, sf).toArrow(), duck.sql(catalog.oracle_sql()[name]).to_arrow_table())


@pytest.mark.parametrize("name", ["train_val_split", "images_per_scene", "contiguous_window", "covisibility_walk"])
def test_draws_repeat(spark, sf, name):
    run = catalog.queries()[name]
    first, second = (sorted(map(tuple, run(spark, sf).collect())) for _ in range(2))
    assert first and first == second


def test_entry_module(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_covisibility_is_a_hash_or_merge_join(spark, sf):
    text = plan(catalog.queries()["covisibility"](spark, sf))
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_filters_and_columns_reach_the_scan(spark, sf):
    text = plan(catalog.queries()["point_quality_fallback"](spark, sf))
    assert "l_shipdate" not in text and "ReadSchema" in text


def test_topk_is_limited_before_the_shuffle(spark, sf):
    assert "WindowGroupLimit" in plan(catalog.queries()["obs_topk_per_frame"](spark, sf))
