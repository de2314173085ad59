"""Every registered query against its SQL twin, and the shape of the plans."""

import pytest

from compare import compare, connect
from flowlattice.plans import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    if name not in catalog.ORACLES:
        assert df.count() > 0
        return
    result = compare(df, con, catalog.ORACLES[name])
    assert isinstance(result, tuple), result


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["run_id", "camera_id", "origin", "destination", "cls", "cnt", "is_total"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_reach_the_scan(spark):
    plan = plan_of(catalog.kept(spark, FOLDER).select("event_id", "conf"))
    assert "GreaterThanOrEqual(conf,0.1)" in plan and "In(cls" in plan
    assert "track_id" not in plan.split("ReadSchema")[1]


def test_routes_of_bounded_runs_shuffle_once(spark):
    assert plan_of(catalog.routes(spark, FOLDER)).count("Exchange") == 1


def test_no_cross_products_and_no_lone_partitions(spark):
    for name in ("od_matrix_long", "zone_routes", "line_sides", "iou_pairs", "heat_smooth", "tiles_of_box"):
        plan = plan_of(catalog.QUERIES[name](spark, FOLDER))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
