"""Properties of the plans: what is pushed down, what is not done, where Python runs."""

import pytest

from depotflow.operators import filters, kpi, ranking
from depotflow.plans.catalog import QUERIES
from depotflow.plans.fixtures import fixture
from depotflow.sources.movement import read_movement, land_movement
from depotflow.session import fresh_path

SF_DIR = "/root/testdata/sf0.001"
IN_PYTHON = {
    "sequence_routes", "route_legs", "route_summary", "dispatch_detail", "workload_gap",
    "workload_extremes", "depot_scenarios"}
WRITERS = {
    "land_movement", "landed_month", "write_csv", "write_dispatch", "split_by_column",
    "write_orders", "classify_stream", "match_returns_stream", "transfer_candidates",
    "transfer_candidates_near"}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def landed(spark):
    path = fresh_path(spark, "movement")
    land_movement(fixture(spark, SF_DIR, "movement"), path)
    return read_movement(spark, path)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in WRITERS])
def test_no_cross_join_and_python_only_for_routes(spark, name):
    plan = plan_of(QUERIES[name](spark, SF_DIR))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    python = [w for w in ("MapInPandas", "InArrow", "ArrowEvalPython", "BatchEvalPython") if w in plan]
    assert bool(python) == (name in IN_PYTHON), python


def test_only_needed_columns_are_read(landed):
    plan = plan_of(kpi.plant_daily_kpi(landed, ["OUTBOUND"], ["PLANT_0"], "2000-01-01", "2000-12-31"))
    schema = plan[plan.index("ReadSchema"):].split("\n")[0]
    assert "partner_name" not in schema and "batch" not in schema
    assert "PushedFilters: [" in plan and "EqualTo(move_type,OUTBOUND)" in plan


def test_top_lists_are_cut_inside_tasks(landed):
    assert "TakeOrderedAndProject" in plan_of(ranking.top_products(landed, "OUTBOUND", "PLANT_0"))
    assert "TakeOrderedAndProject" in plan_of(filters.search_movements(landed, limit=5000))
    assert "WindowGroupLimit" in plan_of(ranking.top_products_by_plant(landed))


def test_totals_are_reduced_before_the_shuffle(landed):
    plan = plan_of(kpi.totals_by(landed, "partner_name"))
    assert plan.count("HashAggregate") == 2 and "partial_sum" in plan
