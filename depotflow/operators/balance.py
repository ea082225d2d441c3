"""Workload differences between vehicles, and the stop that would even them out."""

from pyspark.sql import functions as F

from ..functions.geo import geo_distance_km
from ..schema import FLEET_GAP_MIN, PAIR_GAP_MIN
from .routing import all_days, over_days, route_keys, route_totals, shared_totals


def _day_keys(df):
    return [k for k in route_keys(df) if k != "vehicle_id"]


def workload_gap(summary, pairs, minutes=PAIR_GAP_MIN):
    """Minutes between the vehicles of each configured (busy_id, idle_id) pair, per day."""
    keys = _day_keys(summary)

    def side(name):
        return summary.select(
            *keys, F.col("vehicle_id").alias(f"{name}_id"), F.col("minutes").alias(f"{name}_min"))

    gap = F.col("busy_min") - F.col("idle_min")
    return (
        side("busy").join(pairs, "busy_id").join(side("idle"), [*keys, "idle_id"])
        .select(*keys, "busy_id", "idle_id", "busy_min", "idle_min",
                gap.alias("gap_min"), (gap >= minutes).alias("flagged")))


def workload_gap_of_routes(stops, vehicles, pairs, minutes=PAIR_GAP_MIN):
    """The rows of `workload_gap` for `route_summary(stops, vehicles)`.

    That joins the rows of all days and vehicles. Here only routes with stops meet the pairs, and a pair's
    days are added where its rows are returned.
    """
    keys, pair = _day_keys(stops), ["busy_id", "idle_id"]
    shared = shared_totals(route_totals(stops))
    fleet = vehicles.select("vehicle_id")
    listed = pairs.select(*pair).join(fleet.withColumnRenamed("vehicle_id", "busy_id"), "busy_id").join(
        fleet.withColumnRenamed("vehicle_id", "idle_id"), "idle_id").select(*pair)
    once = pairs.select(*pair).distinct()

    def side(name):
        values = [F.when(F.lit(n == name), F.col("minutes")).alias(f"{n}_min") for n in ("busy", "idle")]
        return shared().withColumnRenamed("vehicle_id", f"{name}_id").join(once, f"{name}_id").select(*keys, *pair, *values)

    met = side("busy").unionAll(side("idle")).groupBy(*keys, *pair).agg(
        F.max("busy_min").alias("busy_min"), F.max("idle_min").alias("idle_min"))
    filled = over_days(listed, pair, met, keys, all_days(shared(), keys, known=True)).withColumns(
        {c: F.coalesce(c, F.lit(0.0)) for c in ("busy_min", "idle_min")})
    gap = F.col("busy_min") - F.col("idle_min")
    return filled.select(*keys, *pair, "busy_min", "idle_min", gap.alias("gap_min"), (gap >= minutes).alias("flagged"))


def workload_extremes(summary, minutes=FLEET_GAP_MIN):
    """Busiest and idlest vehicle per day; ties go to the lowest id for the busiest
    and to the highest id for the idlest.

    Vehicles with equal minutes are first reduced to their lowest and highest id: most are idle, and sums over
    plain numbers need no sorting of all rows.
    """
    keys = _day_keys(summary)
    gap = F.col("busy_min") - F.col("idle_min")
    ids = summary.groupBy(*keys, "minutes").agg(
        F.min("vehicle_id").alias("low"), F.max("vehicle_id").alias("high"), F.count("vehicle_id").alias("known"),
        F.count("*").alias("all"))
    high = F.when(F.col("known") == F.col("all"), F.col("high"))  # a NULL id comes behind the others
    return (
        ids.groupBy(*keys)
        .agg(F.max(F.struct("minutes", -F.col("low"))).alias("busy"),
             F.min(F.struct("minutes", -high)).alias("idle"))
        .select(*keys,
                (-F.col("busy.col2")).alias("busy_id"), (-F.col("idle.col2")).alias("idle_id"),
                F.col("busy.minutes").alias("busy_min"), F.col("idle.minutes").alias("idle_min"))
        .withColumns({"gap_min": gap, "flagged": gap >= minutes}))


def transfer_candidates(stops, vehicles, gaps, max_km=None):
    """Per flagged gap, the busy vehicle's stop nearest to the idle vehicle's start.

    With `max_km` only stops closer than that count.
    """
    keys = _day_keys(stops)
    depots = vehicles.select(
        F.col("vehicle_id").alias("idle_id"), F.col("start_lat").alias("idle_lat"),
        F.col("start_lon").alias("idle_lon"))
    open_gaps = gaps.where("flagged").select(*keys, "busy_id", "idle_id").join(depots, "idle_id")
    moves = stops.withColumnRenamed("vehicle_id", "busy_id").join(
        open_gaps, [*keys, "busy_id"]).withColumn(
        "transfer_km", geo_distance_km("idle_lat", "idle_lon", "lat", "lon"))
    if max_km is not None:
        moves = moves.where(F.col("transfer_km") < max_km)
    best = F.min(F.struct("transfer_km", "assign_phase", "order_id")).alias("best")
    return moves.groupBy(*keys, "busy_id", "idle_id").agg(best).select(
        *keys, "busy_id", "idle_id", F.col("best.order_id").alias("order_id"),
        F.col("best.transfer_km").alias("transfer_km"))
