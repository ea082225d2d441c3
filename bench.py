"""Headline queries, median of warm runs, as one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_RUNS (default 3), BENCH_COPIES (default 1). The movement table is landed
first and the movement queries read the landed table; with BENCH_COPIES=n it
holds n copies of the rows with dates shifted by whole years.
"""

import json
import os
import pathlib
import statistics
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))

from pyspark.sql import functions as F  # noqa: E402

from depotflow.functions.calendar import year_month  # noqa: E402
from depotflow.operators import filters, forecast, kpi, ranking, scans  # noqa: E402
from depotflow.plans.catalog import QUERIES  # noqa: E402
from depotflow.plans.fixtures import fixture  # noqa: E402
from depotflow.plans.movement_queries import KPI_ARGS  # noqa: E402
from depotflow.session import build_session, fresh_path  # noqa: E402
from depotflow.sources.movement import land_movement, read_movement  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
COPIES = int(os.environ.get("BENCH_COPIES", "1"))


def with_copies(m):
    if COPIES == 1:
        return m
    years = F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))).alias("copy")
    shifted = m.select("*", years).withColumn(
        "move_date", F.add_months("move_date", F.col("copy") * -12))
    return shifted.drop("copy")


def run(df):
    df.write.format("noop").mode("overwrite").save()


def timed(action, runs=RUNS):
    action()
    seconds = []
    for _ in range(runs):
        begin = time.perf_counter()
        action()
        seconds.append(time.perf_counter() - begin)
    return round(statistics.median(seconds), 3)


def main():
    spark = build_session("bench", f"local[{CPUS}]", **{
        "spark.sql.shuffle.partitions": CPUS,
        "spark.driver.memory": "12g",
        "spark.ui.enabled": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    movement_path, scan_path = (fresh_path(spark, n) for n in ("movement", "scans"))

    begin = time.perf_counter()
    land_movement(with_copies(fixture(spark, SF_DIR, "movement")), movement_path)
    seconds = {"land_movement": round(time.perf_counter() - begin, 3)}
    fixture(spark, SF_DIR, "scans").repartition(int(CPUS)).write.parquet(scan_path)
    m, raw = read_movement(spark, movement_path), spark.read.parquet(scan_path)

    landed = {
        "plant_daily_kpi": lambda: kpi.plant_daily_kpi(m, *KPI_ARGS),
        "top_products_by_plant": lambda: ranking.top_products_by_plant(m),
        "search_movements": lambda: filters.search_movements(
            m, "1999-01-01", "2001-12-31", ["PLANT_1", "PLANT_2"],
            ["OUTBOUND", "RTP", "RETURN"], batch="0_", limit=5000),
        "datetime_range": lambda: filters.datetime_range_filter(
            m, "2000-05-02 10:30:00", "2000-05-20 15:00:00"),
        "outbound_shipments": lambda: filters.outbound_shipments(
            m, "PLANT_2", "2000-01-10 09:00:00", "2000-04-10 18:00:00"),
        "demand_forecast": lambda: forecast.demand_forecast(m, "2001-06-15", hybrid=True),
        "forecast_scenarios": lambda: forecast.forecast_scenarios(m, "2001-06-15"),
        "totals_by_month": lambda: kpi.totals_by(
            m.withColumn("year_month", year_month("move_date")), "year_month", "plant_code"),
        "classify_scans": lambda: scans.classify_scans(raw),
        "extract_gs1": lambda: scans.extract_gs1(raw),
    }
    for name, build in landed.items():
        seconds[name] = timed(lambda build=build: run(build()))
    for name in ("match_returns", "assign_vehicles", "sequence_routes", "route_summary"):
        seconds[name] = timed(lambda name=name: run(QUERIES[name](spark, SF_DIR)))

    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": pathlib.Path(SF_DIR).name.removeprefix("sf"),
        "copies": COPIES,
        "cpus": int(CPUS),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
