import pytest

from tests.oracle import compare
from tidings import plans


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_equals_sql(spark, sf, name):
    assert compare(spark, sf, plans.QUERIES[name], plans.ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_runs(spark, sf, name):
    df = plans.QUERIES[name](spark, sf)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 25
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_filters_and_columns_reach_the_scan(spark, sf):
    plan = plans.QUERIES["list_total"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in plan and "CartesianProduct" not in plan
    for name in ("interval_join_window", "asof_latest_in_range", "trigram_similarity_topk", "boundary_longest_match", "candidate_pairs_place_time"):
        plan = plans.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan
