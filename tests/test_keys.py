"""Order keys that restart each day, empty and large fleets, lazy building, and inputs that fixtures lack."""

import csv
import glob

import pytest

from depotflow.functions.text import parse_coord
from depotflow.operators import dispatch, filters, kpi, routing
from depotflow.plans.catalog import QUERIES
from depotflow.sources.sinks import write_csv

ORDERS = ("order_id long, route_day int, address string, lat double, lon double")
FLEET = "vehicle_id long, vehicle_name string, start_lat double, start_lon double, efficiency double"


@pytest.fixture
def orders(spark):
    return spark.createDataFrame(
        [(1, 1, "a", 35.0, 129.0), (1, 2, "b", 36.0, 128.0), (2, 1, "c", 36.0, 128.0), (2, 2, "zone9", 35.0, 129.0)], ORDERS)


@pytest.fixture
def fleet(spark):
    return spark.createDataFrame([(0, "v0", 35.0, 129.0, 9.0), (1, "v1", 36.0, 128.0, 9.0)], FLEET)


@pytest.fixture
def zones(spark):
    return spark.createDataFrame([(1, "zone9")], "vehicle_id long, keyword string")


@pytest.mark.parametrize("max_inline", [100, 0], ids=["inline", "join"])
def test_ids_restart_each_day(orders, fleet, zones, max_inline):
    found = dispatch.assign_vehicles(orders, fleet, zones, max_inline)
    assert {(r.order_id, r.route_day): r.vehicle_id for r in found.collect()} == {
        (1, 1): 0, (1, 2): 1, (2, 1): 1, (2, 2): 1}
    stops = routing.plan_routes(found)
    assert dispatch.dispatch_detail(orders, stops, fleet).count() == 4


@pytest.mark.parametrize("max_inline", [100, 0], ids=["inline", "join"])
def test_empty_fleet_gives_no_rows(orders, fleet, zones, max_inline):
    assert dispatch.assign_vehicles(orders, fleet.limit(0), zones, max_inline).count() == 0


def test_fleet_over_the_bound_is_an_error(orders, fleet, zones):
    with pytest.raises(Exception, match="max_inline=0"):
        dispatch.assign_vehicles(orders, fleet, zones, 1).collect()


@pytest.mark.parametrize("name", ["zone_candidates", "assign_vehicles", "route_summary", "depot_scenarios"])
def test_queries_take_a_fleet_of_a_thousand(spark, name):
    assert QUERIES[name](spark, "/root/testdata/sf0.1").count() > 0


@pytest.mark.parametrize("max_inline", [100, 0], ids=["inline", "join"])
def test_building_starts_no_job(spark, orders, fleet, zones, max_inline):
    starts = spark.createDataFrame([("s", 0, 36.0, 128.0)], "scenario_id string, vehicle_id long, start_lat double, start_lon double")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("build", "")
    routing.depot_scenarios(orders, fleet, zones, starts, max_inline)
    dispatch.zone_candidates(orders, zones, max_inline)
    assert not tracker.getJobIdsForGroup("build")
    spark.sparkContext.setJobGroup("", "")


def test_coordinates_are_degrees(spark):
    rows = spark.createDataFrame([("inf,35",), ("129,35",), ("35,129",), ("nan,1",), ("181,1",)], "c string")
    assert [r[0] for r in rows.select(parse_coord("c")["lat"]).collect()] == [None, 35.0, None, None, None]


def test_addresses_meet_without_any_white_space(spark):
    orders = spark.createDataFrame([(1, "\tSeoul　")], "order_id long, address string")
    geo = spark.createDataFrame([("Seoul ", "127,37")], "address string, coord string")
    assert dispatch.geocode_orders(orders, geo).first().coord == "127,37"


def test_unknown_plant_is_an_error(spark):
    monthly = spark.createDataFrame([("2001-01", "SEOUL", 1)], "year_month string, plant_code string, total_qty long")
    with pytest.raises(Exception, match="SEOUL"):
        kpi.monthly_pivot(monthly, "total_qty").collect()
    assert kpi.monthly_pivot(monthly, "total_qty", ["SEOUL"]).first().SEOUL == 1


def test_csv_quotes_are_doubled(spark, tmp_path):
    text = 'say "x", then\nend'
    write_csv(spark.createDataFrame([(text, 1)], "t string, n int").coalesce(1), str(tmp_path / "out"))
    with open(glob.glob(str(tmp_path / "out/part*"))[0], newline="") as file:
        assert list(csv.reader(file))[1] == [text, "1"]


def test_search_has_no_cap_of_its_own():
    assert filters.search_movements.__defaults__[-1] is None
