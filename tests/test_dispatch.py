"""Assignment, routing and balance on small frames."""

import math
import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from depotflow.functions.geo import geo_distance_km
from depotflow.functions.once import shuffled_once
from depotflow.functions.text import clock_text
from depotflow.operators import balance, dispatch, routing

ORDERS = "order_id long, route_day int, name string, address string, lat double, lon double"
FLEET = "vehicle_id int, vehicle_name string, start_lat double, start_lon double, efficiency double"
ZONES = "vehicle_id int, keyword string"


def fleet_of(spark, *starts):
    return spark.createDataFrame(
        [(i, f"V{i}", lat, lon, 10.0) for i, (lat, lon) in enumerate(starts)], FLEET)


def inverse_geodesic_km(lat1, lon1, lat2, lon2):
    """Vincenty's iteration on the same ellipsoid."""
    a, f = 6378.137, 1 / 298.257223563
    b = (1 - f) * a
    u1, u2 = (math.atan((1 - f) * math.tan(math.radians(v))) for v in (lat1, lat2))
    big_l = lam = math.radians(lon2 - lon1)
    for _ in range(200):
        sin_s = math.hypot(math.cos(u2) * math.sin(lam),
                           math.cos(u1) * math.sin(u2) - math.sin(u1) * math.cos(u2) * math.cos(lam))
        if sin_s == 0:
            return 0.0
        cos_s = math.sin(u1) * math.sin(u2) + math.cos(u1) * math.cos(u2) * math.cos(lam)
        sigma = math.atan2(sin_s, cos_s)
        sin_a = math.cos(u1) * math.cos(u2) * math.sin(lam) / sin_s
        cos2_a = 1 - sin_a ** 2
        cos_2m = cos_s - 2 * math.sin(u1) * math.sin(u2) / cos2_a if cos2_a else 0.0
        c = f / 16 * cos2_a * (4 + f * (4 - 3 * cos2_a))
        new = big_l + (1 - c) * f * sin_a * (
            sigma + c * sin_s * (cos_2m + c * cos_s * (2 * cos_2m ** 2 - 1)))
        if abs(new - lam) < 1e-12:
            break
        lam = new
    w = cos2_a * (a * a - b * b) / (b * b)
    big_a = 1 + w / 16384 * (4096 + w * (-768 + w * (320 - 175 * w)))
    big_b = w / 1024 * (256 + w * (-128 + w * (74 - 47 * w)))
    delta = big_b * sin_s * (cos_2m + big_b / 4 * (
        cos_s * (2 * cos_2m ** 2 - 1)
        - big_b / 6 * cos_2m * (4 * sin_s ** 2 - 3) * (4 * cos_2m ** 2 - 3)))
    return b * big_a * (sigma - delta)


def test_distance_against_an_iterated_geodesic(spark):
    rng = random.Random(3)
    pairs = [tuple(rng.uniform(*r) for r in ((34, 38), (126, 130)) * 2) for _ in range(300)]
    df = spark.createDataFrame(pairs, "a double, b double, c double, d double")
    df = df.select("*", geo_distance_km("a", "b", "c", "d").alias("km"),
                   geo_distance_km("a", "b", "c", "d", "haversine").alias("sphere"))
    for r in df.collect():
        exact = inverse_geodesic_km(r.a, r.b, r.c, r.d)
        assert abs(r.km - exact) < 0.001
        assert abs(r.sphere - exact) < 0.004 * exact + 0.001


def test_distance_of_equal_points_is_zero(spark):
    row = spark.range(1).select(geo_distance_km(*map(F.lit, (35.1, 128.2) * 2)).alias("km")).first()
    assert row.km == 0.0
    with pytest.raises(ValueError):
        geo_distance_km("a", "b", "c", "d", "flat")


@pytest.mark.parametrize("text, lat, lon", [
    ("128.5,35.25", 35.25, 128.5),
    (" 128.5 , 35.25 ,9", 35.25, 128.5),
    ("128.5", None, None),
    ("128.5,", None, None),
    ("ERROR:timeout, retry", None, None),
    ("nan,35", None, None),
    (None, None, None),
])
def test_parse_coord(spark, text, lat, lon):
    row = dispatch.locate(spark.createDataFrame([(text,)], "coord string")).first()
    assert (row.lat, row.lon) == (lat, lon)


def test_vehicle_defaults(spark):
    df = spark.createDataFrame([(0, "A", None, float("nan")), (1, "B", "128.1,35.2", 8.0)],
                               "vehicle_id int, vehicle_name string, start_coord string, efficiency double")
    first, second = dispatch.with_vehicle_defaults(df).orderBy("vehicle_id").collect()
    assert tuple(first)[2:] == (35.1795543, 129.0756416, 9.5)
    assert tuple(second)[2:] == (35.2, 128.1, 8.0)
    assert dispatch.with_vehicle_defaults(df.drop("efficiency")).first().efficiency == 9.5


def test_geocoding_keeps_the_reason(spark):
    orders = spark.createDataFrame([(1, "  "), (2, None), (3, " Here "), (4, "There")],
                                   "order_id long, address string")
    geo = spark.createDataFrame([("Here", "2,2", 2), ("Here ", "9,9", 1)],
                                "address string, coord string, hit int")
    found = {r.order_id: r.coord for r in dispatch.geocode_orders(orders, geo).collect()}
    assert found == {1: "NO_ADDRESS", 2: "NO_ADDRESS", 3: "9,9", 4: "NOT_FOUND"}
    plain = dispatch.geocode_orders(orders, geo.drop("hit")).where("order_id = 3").first()
    assert plain.coord == "2,2"


@pytest.mark.parametrize("max_inline", [100, 0], ids=["inline", "join"])
def test_zone_candidates_match_inside_words(spark, max_inline):
    orders = spark.createDataFrame([(1, "city westgate 1"), (2, "north"), (3, None)],
                                   "order_id long, address string")
    zones = spark.createDataFrame([(0, "gate"), (0, "west"), (1, "westgate"), (2, "south")], ZONES)
    found = dispatch.zone_candidates(orders, zones, max_inline).collect()
    assert sorted(found, key=str) == sorted([(1, 0), (1, 1), (2, None), (3, None)], key=str)


@pytest.mark.parametrize("max_inline", [100, 0], ids=["inline", "join"])
def test_assignment_phases_and_ties(spark, max_inline):
    fleet = fleet_of(spark, (35.0, 128.0), (35.0, 128.0), (35.5, 128.5))
    zones = spark.createDataFrame([(2, "far"), (1, "both"), (2, "both"), (9, "ghost")], ZONES)
    orders = spark.createDataFrame([
        (1, 0, "a", "far place", 35.0, 128.0), (2, 0, "b", "both", 35.0, 128.1),
        (3, 0, "c", "nowhere", 35.0, 128.0), (4, 0, "d", "far", None, None),
        (5, 0, "e", "ghost", 35.6, 128.6), (6, 0, "f", None, 35.0, 128.0)], ORDERS)
    found = dispatch.assign_vehicles(orders, fleet, zones, max_inline).collect()
    assert {r.order_id: (r.vehicle_id, r.assign_phase) for r in found} == {
        1: (2, 1), 2: (1, 2), 3: (0, 3), 5: (2, 3), 6: (0, 3)}
    assert {r.order_id: (r.start_lat, r.start_lon) for r in found}[1] == (35.5, 128.5)


def test_both_ways_of_assigning_agree(spark):
    """Clusters, shared starts, far points, both hemispheres and the date line."""
    rng = random.Random(8)

    def place():
        lat, lon, spread = rng.choice(
            [(35, 128, 0.02), (35.2, 128.4, 1.0), (-33, 151, 0.5), (0, 179.99, 0.05),
             (0, -179.99, 0.05), (78, 15, 2.0), (10, 10, 40.0)])
        return lat + rng.uniform(-spread, spread), (lon + rng.uniform(-spread, spread) + 180) % 360 - 180

    starts = [place() for _ in range(150)]
    fleet = fleet_of(spark, *(starts + starts[:20]))
    zones = spark.createDataFrame([(rng.randrange(170), f"z{rng.randrange(12)}") for _ in range(30)], ZONES)
    orders = spark.createDataFrame(
        [(i, 0, "n", f"z{rng.randrange(40)}", *place()) for i in range(600)], ORDERS)
    one = dispatch.assign_vehicles(orders, fleet, zones)
    two = dispatch.assign_vehicles(orders, fleet, zones, max_inline=0)
    pick = ("order_id", "vehicle_id", "assign_phase")
    first, second = (sorted(df.select(*pick).collect()) for df in (one, two))
    assert len(first) == 600
    assert first == second


def test_assignment_is_a_projection(spark):
    fleet = fleet_of(spark, (35.0, 128.0), (35.5, 128.5))
    zones = spark.createDataFrame([(0, "a")], ZONES)
    orders = spark.range(10).selectExpr(
        "id order_id", "0 route_day", "'x' name", "'a' address", "35.0D lat", "128.0D lon")
    plan = dispatch.assign_vehicles(orders, fleet, zones)._jdf.queryExecution().optimizedPlan()
    outer = plan.toString().split("scalar-subquery")[0]
    assert "Join" not in outer and "Aggregate" not in outer


def brute_route(lats, lons, start):
    here, left, order = start, list(range(len(lats))), []
    while left:
        nxt = min(left, key=lambda i: routing._km_to(
            *here, np.array([lats[i]]), np.array([lons[i]]))[0])
        left.remove(nxt)
        order.append(nxt)
        here = lats[nxt], lons[nxt]
    return order


def random_places(n, digits):
    rng = random.Random(n)
    places = dict.fromkeys(
        (round(rng.uniform(35, 36), digits), round(rng.uniform(128, 129), digits)) for _ in range(n))
    return (np.array(v) for v in zip(*places))


@pytest.mark.parametrize("n, digits", [(1, 4), (40, 1), (150, 2)])
def test_visit_order_is_nearest_neighbour(n, digits):
    lats, lons = random_places(n, digits)
    assert list(routing.visit_order(lats, lons, 35.3, 128.7)) == brute_route(lats, lons, (35.3, 128.7))


def all_distances_route(lats, lons, here):
    left, order = np.ones(len(lats), bool), []
    for _ in lats:
        order.append(int(np.argmin(np.where(left, routing._km_to(*here, lats, lons), np.inf))))
        left[order[-1]] = False
        here = lats[order[-1]], lons[order[-1]]
    return order


@pytest.mark.parametrize("spread, digits", [((1.0, 1.0), 3), ((0.001, 0.001), 5), ((90.0, 180.0), 0)])
def test_long_routes_visit_in_the_same_order(spread, digits):
    """One region, one town, the whole earth with its poles and the date line; distances tie often."""
    rng = random.Random(9)
    places = dict.fromkeys((round(rng.uniform(-1, 1) * spread[0], digits), round(rng.uniform(-1, 1) * spread[1], digits))
                           for _ in range(3000))
    lats, lons = (np.array(v) for v in zip(*places))
    found = list(routing.visit_order(lats, lons, 0.4, 0.7))
    assert found == all_distances_route(lats, lons, (0.4, 0.7))
    assert sorted(found) == list(range(len(lats)))


def stops_frame(spark, n=60, days=3, digits=1):
    rng = random.Random(4)
    rows = [(i, i % days, i % 2, 1 + i % 3, round(rng.uniform(35, 36), digits),
             round(rng.uniform(128, 129), digits), 35.0, 128.0) for i in range(n)]
    return spark.createDataFrame(
        rows, "order_id long, route_day int, vehicle_id int, assign_phase int, lat double, "
              "lon double, start_lat double, start_lon double")


def test_sequence_is_a_permutation_and_each_step_nearest(spark):
    found = routing.sequence_routes(stops_frame(spark)).collect()
    assert len(found) == 60
    routes = {}
    for r in sorted(found, key=lambda r: r.seq):
        routes.setdefault((r.route_day, r.vehicle_id), []).append(r)
    for route in routes.values():
        assert [r.seq for r in route] == list(range(1, len(route) + 1))
        tie_order = sorted(route, key=lambda r: (r.assign_phase, r.order_id))
        expected = brute_route([r.lat for r in tie_order], [r.lon for r in tie_order], (35.0, 128.0))
        assert [tie_order[i].order_id for i in expected] == [r.order_id for r in route]


def test_routes_over_the_guard_are_an_error(spark):
    stops = stops_frame(spark)  # 10 a route
    assert routing.sequence_routes(stops, max_stops=10).count() == 60
    for build in (routing.sequence_routes, routing.plan_routes):
        with pytest.raises(Exception, match="max_stops=9"):
            build(stops, max_stops=9).collect()


def test_plan_equals_legs_and_clock_of_the_sequence(spark):
    stops = stops_frame(spark)
    plan = routing.plan_routes(stops)
    apart = routing.with_eta(routing.route_legs(routing.sequence_routes(stops)))
    assert set(plan.columns) == set(apart.columns)
    assert plan._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    figures = ("leg_km", "return_km", "leg_min", "clock_min")
    one, two = (df.select("order_id", "seq", "is_last", "eta", *[F.round(c, 8).alias(c) for c in figures])
                .orderBy("order_id").collect() for df in (plan, apart.select(*plan.columns)))
    assert one == two and len(one) == 60


def test_short_and_long_routes_in_one_call_keep_their_order(spark):
    rng = random.Random(5)
    sizes = [1, 2, 3, routing.BUCKET, routing.BUCKET + 1, 200]
    rows = [(scenario, day, i, rng.choice([1, 2, None]), 35 + rng.randrange(9) / 8, 128 + rng.randrange(9) / 8, 35.0, 128.0)
            for scenario in ("x", None) for day, size in enumerate(sizes) for i in rng.sample(range(size), size)]
    stops = spark.createDataFrame([(s, d, 7, *r) for s, d, *r in rows], "scenario_id string, route_day int, vehicle_id int, "
                                  "order_id long, assign_phase int, lat double, lon double, start_lat double, start_lon double")
    plan = routing.plan_routes(stops)
    assert "FlatMapGroups" not in plan._jdf.queryExecution().executedPlan().toString()  # a call a route costs more than the route
    found = {}
    for r in plan.orderBy("seq").collect():
        found.setdefault((r.scenario_id, r.route_day), []).append(r)
    assert len(found) == 12
    for (scenario, day), route in found.items():
        assert [r.seq for r in route] == list(range(1, sizes[day] + 1))
        ties = sorted((r for r in rows if r[:2] == (scenario, day)), key=lambda r: (r[3] is None, r[3] or 0, r[2]))
        places = list(dict.fromkeys(r[4:6] for r in ties))
        walk = [places[i] for i in brute_route([p[0] for p in places], [p[1] for p in places], (35.0, 128.0))]
        assert [r.order_id for r in route] == [r[2] for place in walk for r in ties if r[4:6] == place]
        assert route[-1].is_last and route[-1].clock_min == pytest.approx(sum(r.leg_min for r in route))


def test_idle_days_are_not_shuffled(spark):
    """Rows of a summary and of gaps that stand for no stop are made in the last step; the stops are walked once."""
    plan = routing.plan_routes(stops_frame(spark))
    fleet = fleet_of(spark, *[(35.0, 128.0)] * 300).union(fleet_of(spark, (35.0, 128.0)))
    pairs = spark.createDataFrame([(i, i - 1) for i in range(1, 300)] + [(0, 1)] * 2, "busy_id int, idle_id int")
    summary = routing.route_summary(plan, fleet, max_inline=0)
    assert summary.count() == 3 * 301
    gaps = balance.workload_gap_of_routes(plan, fleet, pairs)
    one, two = (sorted(map(tuple, g.select("route_day", "busy_id", "idle_id", F.round("gap_min", 6), "flagged").collect()))
                for g in (gaps, balance.workload_gap(summary, pairs)))
    assert one == two and len(one) == 3 * 304
    for df in (summary, gaps):
        text = df._jdf.queryExecution().executedPlan().toString()
        line = [x.strip() for x in text.split("\n") if x.strip().startswith("+-") and not x.lstrip(" +-").startswith("AdaptiveSpark")]
        at = next(i for i, x in enumerate(line) if "Generate posexplode" in x)
        assert not any("Exchange" in x for x in line[:at])
    noted = spark.createDataFrame([(0, 1, 5.0), (0, None, 5.0), (0, 2, 9.0), (0, 4, 9.0), (None, 3, 1.0)],
                                  "route_day int, vehicle_id int, minutes double")
    extremes = balance.workload_extremes(noted)
    assert {r.route_day: (r.busy_id, r.idle_id) for r in extremes.collect()} == {0: (2, None), None: (3, 3)}
    assert "SortAggregate" not in extremes._jdf.queryExecution().executedPlan().toString().split("Exchange")[-1]


def test_rows_of_many_days_are_written_in_runs(spark, tmp_path):
    """A day takes four bytes a row where no day comes twice in a page; rows come span after span, so it takes less."""
    days, fleet = 25_000, fleet_of(spark, *[(35.0, 128.0)] * 40)
    stops = spark.range(days).select(
        F.col("id").cast("int").alias("route_day"), (F.col("id") % 41).cast("int").alias("vehicle_id"),
        F.lit(1.0).alias("leg_km"), F.lit(1.0).alias("return_km"), F.col("id").cast("double").alias("leg_min"))
    path = str(tmp_path / "summary")
    routing.route_summary(stops, fleet, max_inline=0).write.parquet(path)
    found = spark.read.parquet(path)
    assert found.count() == found.select("route_day", "vehicle_id").distinct().count() == days * 40
    used = found.where("stops > 0")
    assert used.count() == used.where("stops = 1 and km = 2 and route_day % 41 = vehicle_id").count() == \
        sum(d % 41 < 40 for d in range(days))
    groups = [parquet.row_group(g) for f in (tmp_path / "summary").glob("*.parquet")
              for parquet in [pq.ParquetFile(f).metadata] for g in range(parquet.num_row_groups)]
    assert sum(g.column(i).total_compressed_size for g in groups for i in range(g.num_columns)
               if g.column(i).path_in_schema == "route_day") < 2 * days * 40
    assert routing.route_summary(stops.limit(0), fleet, max_inline=0).count() == 0


def test_summary_equals_legs_and_counts_idle_vehicles(spark):
    plan = routing.plan_routes(stops_frame(spark))
    fleet = fleet_of(spark, (35.0, 128.0), (35.0, 128.0), (35.0, 128.0))
    for max_inline in (100, 0):
        summary = {(r.route_day, r.vehicle_id): r for r in
                   routing.route_summary(plan, fleet, max_inline=max_inline).collect()}
        assert len(summary) == 9
        for day in range(3):
            idle = summary[day, 2]
            assert (idle.stops, idle.km, idle.fuel_cost) == (0, 0.0, 0)
        legs = plan.groupBy("route_day", "vehicle_id").agg(
            F.count("*"), F.sum("leg_km") + F.sum("return_km")).collect()
        for day, vehicle, n, km in legs:
            route = summary[day, vehicle]
            assert route.stops == n and route.km == pytest.approx(km)
            assert route.minutes == pytest.approx(km / 35 * 60 + 5 * n)
            assert route.fuel_cost == int(route.km / 10.0 * 1700)


def test_clock_runs_past_midnight(spark):
    df = spark.createDataFrame([(0,), (59,), (899,), (900,), (960,)], "m long")
    assert [r[0] for r in df.select(clock_text(F.col("m"), 9)).collect()] == [
        "09:00", "09:59", "23:59", "24:00", "25:00"]


def test_detail_keeps_orders_without_coordinates(spark):
    orders = spark.createDataFrame([(0, 0, "a", "x", 35.0, 128.0), (99, 0, "b", "x", None, None)], ORDERS)
    stops = routing.plan_routes(stops_frame(spark, n=1))
    fleet = fleet_of(spark, (35.0, 128.0))
    detail = {r.order_id: r for r in dispatch.dispatch_detail(orders, stops, fleet).collect()}
    assert (detail[0].vehicle_name, detail[0].seq) == ("V0", 1)
    assert (detail[99].vehicle_name, detail[99].eta, detail[99].seq) == ("UNASSIGNED", "", None)


def test_gaps_and_extremes(spark):
    summary = spark.createDataFrame(
        [(0, 0, 100.0), (0, 1, 80.0), (0, 2, 80.0), (0, 3, 100.0), (1, 0, 10.0), (1, 1, 9.0)],
        "route_day int, vehicle_id int, minutes double")
    pairs = spark.createDataFrame([(0, 1), (1, 0)], "busy_id int, idle_id int")
    gaps = {(r.route_day, r.busy_id): (r.gap_min, r.flagged)
            for r in balance.workload_gap(summary, pairs).collect()}
    assert gaps == {(0, 0): (20.0, True), (0, 1): (-20.0, False),
                    (1, 0): (1.0, False), (1, 1): (-1.0, False)}
    extremes = {r.route_day: (r.busy_id, r.idle_id, r.flagged)
                for r in balance.workload_extremes(summary, 20).collect()}
    assert extremes == {0: (0, 2, True), 1: (0, 1, False)}


def test_transfer_takes_the_nearest_stop_within_reach(spark):
    stops = spark.createDataFrame(
        [(0, 0, 5, 2, 35.0, 128.1), (0, 0, 4, 2, 35.0, 128.1), (0, 0, 3, 1, 35.0, 128.4)],
        "route_day int, vehicle_id int, order_id long, assign_phase int, lat double, lon double")
    fleet = fleet_of(spark, (35.0, 129.0), (35.0, 128.0))
    gaps = spark.createDataFrame([(0, 0, 1, True), (1, 0, 1, True)],
                                 "route_day int, busy_id int, idle_id int, flagged boolean")
    (move,) = balance.transfer_candidates(stops, fleet, gaps).collect()
    assert (move.order_id, round(move.transfer_km, 1)) == (4, 9.1)
    assert balance.transfer_candidates(stops, fleet, gaps, 9.0).count() == 0


@pytest.mark.parametrize("max_inline", [100, 0], ids=["inline", "join"])
def test_scenarios_equal_separate_runs(spark, max_inline):
    rng = random.Random(2)
    orders = spark.createDataFrame(
        [(i, i % 2, "n", rng.choice("abc"), 35 + rng.random(), 128 + rng.random())
         for i in range(60)], ORDERS)
    fleet = fleet_of(spark, (35.1, 128.1), (35.9, 128.9), (35.5, 128.2))
    zones = spark.createDataFrame([(0, "a"), (1, "a")], ZONES)
    starts = spark.createDataFrame([("x", 0, 35.8, 128.3), ("y", 2, 35.2, 128.8)],
                                   "scenario_id string, vehicle_id int, start_lat double, start_lon double")
    found = routing.depot_scenarios(orders, fleet, zones, starts, max_inline)
    for scenario, vehicle, lat, lon in starts.collect():
        moved = fleet.withColumns({
            "start_lat": F.when(F.col("vehicle_id") == vehicle, lat).otherwise(F.col("start_lat")),
            "start_lon": F.when(F.col("vehicle_id") == vehicle, lon).otherwise(F.col("start_lon"))})
        alone = routing.route_summary(routing.plan_routes(
            dispatch.assign_vehicles(orders, moved, zones)), moved)
        pick = ("route_day", "vehicle_id", "stops", "total_km", "fuel_cost")
        assert sorted(found.where(F.col("scenario_id") == scenario).select(*pick).collect()) == \
            sorted(alone.select(*pick).collect())


def test_a_coordinate_text_is_read_once_a_row(spark):
    df = spark.createDataFrame([(1, "128.5,35.5"), (2, "1,95"), (3, "x"), (4, None)], "order_id int, coord string")
    found = dispatch.only_located(dispatch.locate(df))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and plan.count("cast(") == 2
    assert found.columns == ["order_id", "coord", "lat", "lon"]
    assert [tuple(r) for r in found.collect()] == [(1, "128.5,35.5", 35.5, 128.5)]
    # a frame that has the columns gets them in their places
    assert dispatch.locate(found).columns == found.columns


def test_uses_of_shuffled_rows_share_one_shuffle(spark, tmp_path):
    spark.range(100).withColumn("text", F.col("id").cast("string")).write.parquet(str(tmp_path / "rows"))
    rows = shuffled_once(spark.read.parquet(str(tmp_path / "rows")), ["id"])
    both = rows().groupBy("id").count().join(rows().select("id", "text"), "id")
    assert both.count() == 100
    both.collect()
    plan = both._jdf.queryExecution().executedPlan().toString()
    final = plan[:plan.find("== Initial Plan ==")] if "== Initial Plan ==" in plan else plan
    assert final.count("FileScan parquet") == 1 and "ReusedExchange" in final
