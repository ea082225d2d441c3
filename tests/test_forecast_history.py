"""Forecasts of many dates from running totals."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from test_movement import move

from depotflow.operators.forecast import forecast_scenarios
from depotflow.operators.forecast_history import forecast_dates, sales_history
from depotflow.schema import MOVEMENT

DATES = [dt.date(2022 + i // 12, i % 12 + 1, (1, 15, 28)[i % 3]) for i in range(24)]


def movement(spark, n=900):
    """Products that start late, stop early or pause; NULL days, names and quantities; no sale at all in some months."""
    rows = []
    for i in range(n):
        day = dt.date(2021, 1, 1) + dt.timedelta(days=(i * 37) % 1300)
        if day.month == 8:
            continue
        rows.append(move(
            move_date=None if i % 67 == 0 else day, qty=None if i % 53 == 0 else i % 9, amount=i * 13 % 50,
            product_name=None if i % 11 == 0 else f"X{i % 7}", partner_name=None if i % 41 == 0 else f"P{i % 3}",
            move_type="PURCHASE" if i % 17 == 0 else "OUTBOUND"))
    return spark.createDataFrame(rows, MOVEMENT)


@pytest.mark.parametrize("basis, dates, lookbacks", [("row", DATES, (3,)), ("month", DATES[::7], (1, 3))])
def test_every_date_equals_its_own_forecast(spark, basis, dates, lookbacks):
    m = movement(spark)
    found = {}
    for row in forecast_dates(sales_history(m), dates, lookbacks, (False, True), basis).collect():
        found.setdefault(row.as_of, []).append(str(tuple(row)[1:]))
    assert len(found) > 0.8 * len(dates)
    for day in dates:
        alone = forecast_scenarios(m, day, lookbacks, (False, True), recent_basis=basis).collect()
        assert sorted(found.get(day, [])) == sorted(str(tuple(r)) for r in alone)


def test_history_is_read_back_without_movement(spark, tmp_path):
    m = movement(spark)
    sales_history(m).write.parquet(f"{tmp_path}/history")
    kept = spark.read.parquet(f"{tmp_path}/history")
    a = forecast_dates(kept, [DATES[14], "2023-05-28", DATES[14]])
    assert sorted(map(str, a.where(F.col("as_of") == DATES[14]).drop("as_of").collect())) == \
        sorted(map(str, forecast_scenarios(m, DATES[14], (3,), (False,)).collect()))
    assert a.select("as_of").distinct().count() == 2


def test_nothing_to_forecast(spark):
    m = movement(spark)
    assert forecast_dates(sales_history(m), []).count() == 0
    assert forecast_dates(sales_history(m.limit(0)), DATES).count() == 0
    with pytest.raises(ValueError):
        forecast_dates(sales_history(m), DATES, recent_basis="week")


def test_partners_are_chosen_before_grouping(spark):
    only = sales_history(movement(spark), partners=["P1"])
    assert {r.partner_name for r in only.collect()} == {"P1"}
