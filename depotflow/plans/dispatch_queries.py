"""Queries over delivery orders, vehicles and routes.

The SQL computes distances with the same ellipsoid formula in its textbook
form, and routes with a recursive query.
"""

from pyspark.sql import functions as F

from ..functions.geo import EARTH_A_KM, FLATTENING, MEAN_RADIUS_KM, geo_distance_km
from ..operators import balance, dispatch, routing
from ..operators.filters import limit_rows
from ..schema import FLEET_SIZE, ORDERS_PER_DAY, TRANSFER_MAX_KM
from ..session import fresh_path
from .registry import query, sql_with
from .workflows import plan_stops


def _reduced(lat):
    return f"atan((1 - {FLATTENING!r}) * tan(radians({lat})))"


def km_sql(lat1, lon1, lat2, lon2):
    """Lambert's formula with the central angle from the haversine, 0 for equal points."""
    b1, b2 = _reduced(lat1), _reduced(lat2)
    angle = (f"2 * asin(sqrt(least(1.0, pow(sin(({b2} - {b1}) / 2), 2) + cos({b1}) * cos({b2}) * "
             f"pow(sin(radians({lon2} - {lon1}) / 2), 2))))")
    half_sum, half_diff = f"({b1} + {b2}) / 2", f"({b2} - {b1}) / 2"
    x = (f"({angle} - sin({angle})) * pow(sin({half_sum}) * cos({half_diff}), 2)"
         f" / pow(cos({angle} / 2), 2)")
    y = (f"({angle} + sin({angle})) * pow(cos({half_sum}) * sin({half_diff}), 2)"
         f" / pow(sin({angle} / 2), 2)")
    return (f"CASE WHEN {lat1} = {lat2} AND {lon1} = {lon2} THEN 0.0 ELSE "
            f"{EARTH_A_KM} * ({angle} - {FLATTENING!r} / 2 * ({x} + {y})) END")


LOCATED = """
located AS (
  SELECT *, TRY_CAST(split_part(coord, ',', 2) AS DOUBLE) AS lat_,
         TRY_CAST(split_part(coord, ',', 1) AS DOUBLE) AS lon_ FROM delivery_orders),
points AS (
  SELECT * EXCLUDE (lat_, lon_), CASE WHEN lon_ IS NOT NULL THEN lat_ END AS lat,
         CASE WHEN lat_ IS NOT NULL THEN lon_ END AS lon FROM located)"""


def _fleet(where="TRUE"):
    return f"""
fleet AS (
  SELECT vehicle_id, vehicle_name,
         COALESCE(TRY_CAST(split_part(start_coord, ',', 2) AS DOUBLE), 35.1795543) AS start_lat,
         COALESCE(TRY_CAST(split_part(start_coord, ',', 1) AS DOUBLE), 129.0756416) AS start_lon,
         COALESCE(efficiency, 9.5) AS efficiency
  FROM vehicles WHERE {where})"""


FLEET = _fleet()
ASSIGNED = f"""
pairs AS (
  SELECT DISTINCT o.order_id, f.vehicle_id FROM points o
  JOIN vehicle_zone z ON contains(o.address, z.keyword) JOIN fleet f USING (vehicle_id)
  WHERE o.lat IS NOT NULL),
sizes AS (SELECT order_id, COUNT(*) AS n FROM pairs GROUP BY order_id),
choices AS (
  SELECT o.order_id, f.vehicle_id, COALESCE(s.n, 0) AS n, f.start_lat, f.start_lon,
         {km_sql('f.start_lat', 'f.start_lon', 'o.lat', 'o.lon')} AS km
  FROM points o LEFT JOIN sizes s USING (order_id) CROSS JOIN fleet f
  WHERE o.lat IS NOT NULL AND (s.n IS NULL OR
    (o.order_id, f.vehicle_id) IN (SELECT (order_id, vehicle_id) FROM pairs))),
assigned AS (
  SELECT o.*, c.vehicle_id, c.km AS distance_km,
         CASE WHEN c.n = 0 THEN 3 WHEN c.n = 1 THEN 1 ELSE 2 END AS assign_phase,
         c.start_lat, c.start_lon
  FROM points o JOIN (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY order_id ORDER BY km, vehicle_id) AS k
    FROM choices) c USING (order_id) WHERE c.k = 1)"""
DELIVERY = ["delivery_orders", "vehicles", "vehicle_zone"]


def _walk(keys):
    """Nearest-neighbour walk over `assigned`, one step of every route per iteration."""
    key_list, same = ", ".join(keys), " AND ".join(f"s.{k} = w.{k}" for k in keys)
    s_keys = ", ".join(f"s.{k}" for k in keys)
    step = km_sql("w.lat", "w.lon", "s.lat", "s.lon")
    return f"""
walk AS (
  SELECT DISTINCT {key_list}, 0 AS seq, CAST(-1 AS BIGINT) AS order_id, 0 AS assign_phase,
         start_lat AS lat, start_lon AS lon, start_lat, start_lon, CAST(0 AS DOUBLE) AS leg_km,
         CAST([] AS BIGINT[]) AS seen
  FROM assigned
  UNION ALL
  SELECT * EXCLUDE (k) FROM (
    SELECT {s_keys}, w.seq + 1, s.order_id, s.assign_phase, s.lat, s.lon, s.start_lat, s.start_lon,
           {step} AS km, list_append(w.seen, s.order_id),
           ROW_NUMBER() OVER (PARTITION BY {s_keys} ORDER BY {step}, s.assign_phase, s.order_id) AS k
    FROM walk w JOIN assigned s ON {same}
    WHERE NOT list_contains(w.seen, s.order_id)) WHERE k = 1),
sequenced AS (
  SELECT {key_list}, order_id, assign_phase, lat, lon, start_lat, start_lon,
         CAST(seq AS INT) AS seq, leg_km FROM walk WHERE seq > 0),
legs AS (
  SELECT *, seq = MAX(seq) OVER (PARTITION BY {key_list}) AS is_last,
         CASE WHEN seq = MAX(seq) OVER (PARTITION BY {key_list})
              THEN {km_sql('lat', 'lon', 'start_lat', 'start_lon')} ELSE 0.0 END AS return_km,
         leg_km / 35 * 60 + 5 AS leg_min FROM sequenced),
clocked AS (
  SELECT *, SUM(leg_min) OVER (PARTITION BY {key_list} ORDER BY seq) AS clock_min FROM legs),
stops AS (
  SELECT *, printf('%02d:%02d', 9 + CAST(TRUNC(clock_min - 5) AS BIGINT) // 60,
                   CAST(TRUNC(clock_min - 5) AS BIGINT) % 60) AS eta FROM clocked)"""


def _summary(days):
    """Totals of every vehicle of the fleet for each row of `days`."""
    keys = ", ".join(days)
    return f"""
totals AS (
  SELECT {keys}, vehicle_id, COUNT(*) AS stops, SUM(leg_km + return_km) AS km,
         SUM(leg_min + return_km / 35 * 60) AS minutes FROM stops GROUP BY ALL),
summary AS (
  SELECT {keys}, vehicle_id, f.vehicle_name, f.efficiency, COALESCE(t.stops, 0) AS stops,
         COALESCE(t.km, 0.0) AS km, COALESCE(t.minutes, 0.0) AS minutes,
         ROUND_EVEN(COALESCE(t.km, 0.0), 1) AS total_km,
         ROUND_EVEN(COALESCE(t.minutes, 0.0) / 60, 1) AS total_hours,
         CAST(TRUNC(COALESCE(t.km, 0.0) / f.efficiency * 1700) AS BIGINT) AS fuel_cost
  FROM (SELECT DISTINCT {keys} FROM assigned) d CROSS JOIN fleet f
  LEFT JOIN totals t USING ({keys}, vehicle_id))"""


ROUTE = ("route_day", "vehicle_id")
PLAN = [LOCATED, FLEET, ASSIGNED, _walk(ROUTE), _summary(["route_day"])]


def _round(columns, places=6):
    return f"* REPLACE ({', '.join(f'ROUND({c}, {places}) AS {c}' for c in columns)})"


def _rounded(df, *columns):
    return df.withColumns({c: F.when(F.col(c) == 0, 0.0).otherwise(F.round(c, 6)) for c in columns})


def located(t):
    return dispatch.locate(t.delivery_orders)


def whole_fleet(t):
    """All vehicles, with defaults."""
    return dispatch.with_vehicle_defaults(t.vehicles)


def assigned(t):
    return dispatch.assign_vehicles(located(t), whole_fleet(t), t.vehicle_zone, max_inline=0)


def planned(t):
    return routing.plan_routes(assigned(t))


def summarised(t):
    return routing.route_summary(planned(t), whole_fleet(t), max_inline=0)


def relief(t):
    """Pairs of vehicles for the gap report: each may hand stops to the one before it."""
    ids = whole_fleet(t).select(F.col("vehicle_id").alias("busy_id"))
    return ids.where(F.col("busy_id") > 0).withColumn("idle_id", F.col("busy_id") - 1)


RELIEF = """relief AS (
  SELECT vehicle_id AS busy_id, vehicle_id - 1 AS idle_id FROM fleet WHERE vehicle_id > 0)"""


@query("total_load", "P10", sql_with(["delivery_orders"], """
SELECT * REPLACE (COALESCE(box_qty, 0) AS box_qty, COALESCE(bag_qty, 0) AS bag_qty),
       COALESCE(box_qty, 0) * CAST(1.0 AS DOUBLE)
         + COALESCE(bag_qty, 0) * CAST(0.2 AS DOUBLE) AS total_load
FROM delivery_orders"""))
def _(t):
    return dispatch.with_total_load(t.delivery_orders)


@query("parse_coord", "P11 X12", sql_with(["delivery_orders"], "SELECT * FROM points", [LOCATED]))
def _(t):
    return located(t)


@query("first_orders", "P12", sql_with(["delivery_orders"], f"""
SELECT * FROM delivery_orders ORDER BY order_id LIMIT {ORDERS_PER_DAY}"""))
def _(t):
    return limit_rows(t.delivery_orders, ORDERS_PER_DAY, "order_id")


@query("first_vehicles", "P12", sql_with(["vehicles"], f"""
SELECT * FROM vehicles ORDER BY vehicle_id LIMIT {FLEET_SIZE}"""))
def _(t):
    return limit_rows(t.vehicles, FLEET_SIZE, "vehicle_id")


@query("vehicle_defaults", "P13", sql_with(["vehicles"], "SELECT * FROM fleet", [_fleet()]))
def _(t):
    return dispatch.with_vehicle_defaults(t.vehicles)


@query("depot_center", "X17", sql_with(["vehicles"], """
SELECT ROUND(AVG(start_lat), 6) AS lat, ROUND(AVG(start_lon), 6) AS lon FROM fleet""", [_fleet()]))
def _(t):
    center = dispatch.depot_center(dispatch.with_vehicle_defaults(t.vehicles))
    return _rounded(center, "lat", "lon")


@query("geo_distance", "X15", sql_with(["delivery_orders"], f"""
SELECT order_id, ROUND({km_sql('35.1795543', '129.0756416', 'lat', 'lon')}, 6) AS km,
       ROUND(2 * {MEAN_RADIUS_KM} * asin(sqrt(pow(sin(radians(lat - 35.1795543) / 2), 2)
         + cos(radians(35.1795543)) * cos(radians(lat)) * pow(sin(radians(lon - 129.0756416) / 2), 2)
       )), 6) AS haversine_km
FROM points WHERE lat IS NOT NULL""", [LOCATED]))
def _(t):
    depot = F.lit(35.1795543), F.lit(129.0756416)
    return located(t).where(F.col("lat").isNotNull()).select(
        "order_id",
        F.round(geo_distance_km(*depot, "lat", "lon"), 6).alias("km"),
        F.round(geo_distance_km(*depot, "lat", "lon", "haversine"), 6).alias("haversine_km"))


@query("geocode_orders", "J6 X13", sql_with(["delivery_orders", "geo_reference"], """
SELECT o.* EXCLUDE (coord), CASE WHEN o.address IS NULL OR trim(o.address) = '' THEN 'NO_ADDRESS'
       WHEN g.coord IS NULL THEN 'NOT_FOUND' ELSE g.coord END AS coord
FROM delivery_orders o LEFT JOIN geo_reference g ON trim(o.address) = trim(g.address)"""))
def _(t):
    return dispatch.geocode_orders(t.delivery_orders, t.geo_reference)


@query("zone_candidates", "J4 X11", sql_with(["delivery_orders", "vehicle_zone"], """
SELECT DISTINCT o.route_day, o.order_id, z.vehicle_id FROM delivery_orders o
LEFT JOIN vehicle_zone z ON contains(o.address, z.keyword)"""))
def _(t):
    return dispatch.zone_candidates(t.delivery_orders, t.vehicle_zone, max_inline=0)


@query("assign_vehicles", "J5", sql_with(
    DELIVERY, f"SELECT {_round(['distance_km'])} FROM assigned", [LOCATED, FLEET, ASSIGNED]))
def _(t):
    return _rounded(assigned(t), "distance_km")


@query("assign_vehicles_whole_fleet", "J5", sql_with(
    DELIVERY, f"SELECT {_round(['distance_km'])} FROM assigned", [LOCATED, _fleet(), ASSIGNED]))
def _(t):
    fleet = dispatch.with_vehicle_defaults(t.vehicles)
    return _rounded(
        dispatch.assign_vehicles(located(t), fleet, t.vehicle_zone, max_inline=0), "distance_km")


@query("assign_vehicles_by_join", "J4 J5", sql_with(
    DELIVERY, f"SELECT {_round(['distance_km'])} FROM assigned", [LOCATED, _fleet(), ASSIGNED]))
def _(t):
    fleet = dispatch.with_vehicle_defaults(t.vehicles)
    found = dispatch.assign_vehicles(located(t), fleet, t.vehicle_zone, max_inline=0)
    return _rounded(found, "distance_km")


def _over_plan(select, *ctes):
    return sql_with(DELIVERY, select, [*PLAN, *ctes], recursive=True)


@query("sequence_routes", "R1", _over_plan("SELECT * EXCLUDE (leg_km) FROM sequenced"))
def _(t):
    return routing.sequence_routes(assigned(t))


@query("route_legs", "R2 W2 W3 X8 X16", _over_plan(
    f"SELECT {_round(['leg_km', 'return_km', 'leg_min', 'clock_min'])} FROM stops"))
def _(t):
    return _rounded(planned(t), "leg_km", "return_km", "leg_min", "clock_min")


@query("route_summary", "A9 R3 X6", _over_plan(f"SELECT {_round(['km', 'minutes'])} FROM summary"))
def _(t):
    return _rounded(summarised(t), "km", "minutes")


@query("dispatch_detail", "J9", _over_plan("""
SELECT o.*, s.vehicle_id, s.seq, COALESCE(f.vehicle_name, 'UNASSIGNED') AS vehicle_name,
       COALESCE(s.eta, '') AS eta
FROM points o LEFT JOIN stops s USING (order_id) LEFT JOIN fleet f ON f.vehicle_id = s.vehicle_id"""))
def _(t):
    return dispatch.dispatch_detail(located(t), planned(t), whole_fleet(t))


GAP = """gaps AS (
  SELECT b.route_day, p.busy_id, p.idle_id, b.minutes AS busy_min, i.minutes AS idle_min,
         b.minutes - i.minutes AS gap_min, b.minutes - i.minutes >= 20 AS flagged
  FROM relief p JOIN summary b ON b.vehicle_id = p.busy_id
  JOIN summary i ON i.vehicle_id = p.idle_id AND i.route_day = b.route_day)"""
MINUTES = ["busy_min", "idle_min", "gap_min"]


@query("workload_gap", "W4", _over_plan(f"SELECT {_round(MINUTES)} FROM gaps", RELIEF, GAP))
def _(t):
    return _rounded(balance.workload_gap_of_routes(planned(t), whole_fleet(t), relief(t)), *MINUTES)


@query("workload_extremes", "W5", _over_plan(f"""
SELECT route_day, busy_id, idle_id, ROUND(busy_min, 6) AS busy_min, ROUND(idle_min, 6) AS idle_min,
       ROUND(busy_min - idle_min, 6) AS gap_min, busy_min - idle_min >= 30 AS flagged
FROM (SELECT route_day, FIRST(vehicle_id ORDER BY minutes DESC, vehicle_id) AS busy_id,
             LAST(vehicle_id ORDER BY minutes DESC, vehicle_id) AS idle_id,
             MAX(minutes) AS busy_min, MIN(minutes) AS idle_min
      FROM summary GROUP BY route_day)"""))
def _(t):
    return _rounded(balance.workload_extremes(summarised(t)), *MINUTES)


def _transfer_sql(where):
    return _over_plan(f"""
SELECT route_day, busy_id, idle_id, order_id, ROUND(km, 6) AS transfer_km FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY route_day, busy_id, idle_id
           ORDER BY km, assign_phase, order_id) AS k
  FROM (SELECT s.route_day, g.busy_id, g.idle_id, s.order_id, s.assign_phase,
               {km_sql('f.start_lat', 'f.start_lon', 's.lat', 's.lon')} AS km
        FROM gaps g JOIN stops s ON s.route_day = g.route_day AND s.vehicle_id = g.busy_id
        JOIN fleet f ON f.vehicle_id = g.idle_id WHERE g.flagged) WHERE {where})
WHERE k = 1""", RELIEF, GAP)


def _transfers(t, max_km=None):
    fleet = whole_fleet(t)
    stops = plan_stops(
        t.delivery_orders, fleet, t.vehicle_zone, fresh_path(t.spark, "transfers"))
    gaps = balance.workload_gap_of_routes(stops, fleet, relief(t))
    moves = balance.transfer_candidates(stops, fleet, gaps, max_km)
    return _rounded(moves, "transfer_km")


@query("transfer_candidates", "W6", _transfer_sql("TRUE"))
def _(t):
    return _transfers(t)


@query("transfer_candidates_near", "W6", _transfer_sql("km < 15"))
def _(t):
    return _transfers(t, TRANSFER_MAX_KM)


def _starts(t):
    """Two what-ifs: every vehicle from the centre of the starts, and the fleet as it is."""
    fleet = whole_fleet(t)
    center = dispatch.depot_center(fleet)
    lat, lon = center.select("lat").scalar(), center.select("lon").scalar()
    central = fleet.select(F.lit("central").alias("scenario_id"), "vehicle_id",
                           F.round(lat, 4).alias("start_lat"), F.round(lon, 4).alias("start_lon"))
    return central.unionByName(fleet.select(
        F.lit("present").alias("scenario_id"), "vehicle_id", "start_lat", "start_lon"))


SCENARIO_ASSIGNED = f"""
fleets AS (
  SELECT 'present' AS scenario_id, vehicle_id, start_lat, start_lon FROM fleet
  UNION ALL
  SELECT 'central', vehicle_id, (SELECT ROUND(AVG(start_lat), 4) FROM fleet),
         (SELECT ROUND(AVG(start_lon), 4) FROM fleet) FROM fleet),
pairs AS (
  SELECT DISTINCT o.order_id, z.vehicle_id FROM points o
  JOIN vehicle_zone z ON contains(o.address, z.keyword)),
sizes AS (SELECT order_id, COUNT(*) AS n FROM pairs GROUP BY order_id),
choices AS (
  SELECT o.*, f.scenario_id, f.vehicle_id, f.start_lat, f.start_lon,
         CASE WHEN s.n IS NULL THEN 3 WHEN s.n = 1 THEN 1 ELSE 2 END AS assign_phase,
         {km_sql('f.start_lat', 'f.start_lon', 'o.lat', 'o.lon')} AS km
  FROM points o LEFT JOIN sizes s USING (order_id) CROSS JOIN fleets f
  WHERE o.lat IS NOT NULL AND (s.n IS NULL OR
    (o.order_id, f.vehicle_id) IN (SELECT (order_id, vehicle_id) FROM pairs))),
assigned AS (
  SELECT * EXCLUDE (k) FROM (SELECT *, ROW_NUMBER() OVER (
    PARTITION BY scenario_id, order_id ORDER BY km, vehicle_id) AS k FROM choices) WHERE k = 1)"""


@query("depot_scenarios", "R4", sql_with(DELIVERY, f"""
SELECT {_round(['km', 'minutes'])} FROM summary""", [
    LOCATED, FLEET, SCENARIO_ASSIGNED, _walk(("scenario_id", *ROUTE)),
    _summary(["scenario_id", "route_day"])], recursive=True))
def _(t):
    found = routing.depot_scenarios(located(t), whole_fleet(t), t.vehicle_zone, _starts(t), max_inline=0)
    return _rounded(found, "km", "minutes")
