"""Operators put together the way a day's work uses them."""

from ..operators import balance, dispatch, kpi, routing
from ..schema import TRANSFER_MAX_KM
from ..sources.sinks import write_dispatch


def kpi_report(m, types, plants, start, end):
    """Daily and monthly KPIs and the month-by-plant tables, as lazy frames."""
    daily = kpi.plant_daily_kpi(m, types, plants, start, end)
    monthly = kpi.plant_monthly_kpi(daily)
    pivots = {measure: kpi.monthly_pivot(monthly, measure, plants) for measure in kpi.MEASURES}
    return {"daily": daily, "monthly": monthly, **pivots}


def plan_stops(orders, vehicles, zones, path):
    """Assigns and sequences orders and writes the stops.

    Finding the stop order is the one step in Python; its result is written
    once, and everything derived from it reads the table.
    """
    assigned = dispatch.assign_vehicles(dispatch.locate(orders), vehicles, zones, max_inline=0)
    routing.plan_routes(assigned).write.mode("errorifexists").parquet(f"{path}/stops")
    return orders.sparkSession.read.parquet(f"{path}/stops")


def dispatch_plan(orders, vehicles, zones, path):
    """Stops, order detail and route summary below `path`."""
    stops = plan_stops(orders, vehicles, zones, path)
    detail = dispatch.dispatch_detail(dispatch.locate(orders), stops, vehicles)
    write_dispatch(detail, routing.route_summary(stops, vehicles, max_inline=0), path)
    return stops


def balance_report(stops, vehicles, pairs, max_km=TRANSFER_MAX_KM):
    """Workload gaps and the stops that would narrow them, for configured pairs
    without a distance limit and for the busiest and idlest vehicle within one."""
    summary = routing.route_summary(stops, vehicles, max_inline=0)
    gaps = balance.workload_gap(summary, pairs)
    extremes = balance.workload_extremes(summary)
    return {
        "gaps": gaps,
        "extremes": extremes,
        "pair_moves": balance.transfer_candidates(stops, vehicles, gaps),
        "fleet_moves": balance.transfer_candidates(stops, vehicles, extremes, max_km),
    }
