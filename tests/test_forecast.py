"""Forecast windows, unnamed products and rounding."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from test_movement import move

from depotflow.functions.calendar import forecast_windows, month_range
from depotflow.operators.forecast import demand_forecast, forecast_scenarios
from depotflow.schema import MOVEMENT

AS_OF = dt.date(2024, 6, 15)
RECENT, LAST_YEAR, NOW = dt.date(2024, 5, 2), dt.date(2023, 6, 30), dt.date(2024, 6, 30)


@pytest.fixture
def frame(spark):
    return lambda *rows: spark.createDataFrame([move(**r) for r in rows], MOVEMENT)


@pytest.mark.parametrize("as_of, lookback, start, end", [
    ("2024-06-15", 3, "2024-03-01", "2024-05-31"),
    ("2023-03-10", 1, "2023-01-01", "2023-02-28"),  # 30 days back skips February
    ("2024-03-10", 1, "2024-01-01", "2024-02-29"),
    ("2023-05-10", 3, "2023-01-01", "2023-04-30"),
    ("2024-05-10", 3, "2024-02-01", "2024-04-30"),
    ("2024-01-31", 6, "2023-07-01", "2023-12-31"),
])
def test_recent_window(as_of, lookback, start, end):
    window = forecast_windows(as_of, lookback)["recent"]
    assert window == (dt.date.fromisoformat(start), dt.date.fromisoformat(end))


def test_month_range():
    assert month_range(2023, 12) == (dt.date(2023, 12, 1), dt.date(2023, 12, 31))
    assert month_range(2024, 2)[1] == dt.date(2024, 2, 29)


def one(df):
    (row,) = df.collect()
    return row


def test_plain_and_hybrid(frame):
    m = frame({"move_date": RECENT, "qty": 10, "amount": 100},
              {"move_date": RECENT, "qty": 5, "amount": 100},
              {"move_date": LAST_YEAR, "qty": 20, "amount": 20},
              {"move_date": NOW, "qty": 3, "amount": 3})
    row = one(demand_forecast(m, AS_OF))
    assert (row.avg_recent, row.last_year_qty, row.current_qty) == (7.5, 20.0, 3.0)
    assert row.unit_price == 8.0  # (10 + 20 + 1 + 1) / 4
    assert (row.forecast_qty, row.suggested_qty, row.extra_revenue) == (7.5, 4.5, 36)
    assert one(demand_forecast(m, AS_OF, hybrid=True)).forecast_qty == 15.0
    assert one(demand_forecast(m, AS_OF, recent_basis="month")).avg_recent == 5.0


def test_no_last_year_falls_back_to_recent(frame):
    m = frame({"move_date": RECENT, "qty": 4})
    assert one(demand_forecast(m, AS_OF, hybrid=True)).forecast_qty == 4.0


def test_price_alone_admits_no_product(frame):
    m = frame({"move_date": dt.date(2020, 1, 1), "qty": 4})
    assert demand_forecast(m, AS_OF).count() == 0


def test_zero_quantity_has_no_price(frame):
    m = frame({"move_date": RECENT, "qty": 0}, {"move_date": RECENT, "qty": 8, "amount": 16})
    row = one(demand_forecast(m, AS_OF))
    assert (row.avg_recent, row.unit_price) == (4.0, 2.0)


def test_unnamed_product_windows_stay_apart(frame):
    m = frame({"move_date": RECENT, "product_name": None, "qty": 4},
              {"move_date": LAST_YEAR, "product_name": None, "qty": 10},
              {"move_date": NOW, "product_name": None, "qty": 2})
    plain = one(demand_forecast(m, AS_OF))
    assert (plain.avg_recent, plain.current_qty, plain.unit_price) == (4.0, 0.0, 0.0)
    hybrid = demand_forecast(m, AS_OF, hybrid=True).collect()
    assert sorted(r.forecast_qty for r in hybrid) == [4.0, 6.0]


def test_other_types_and_nameless_partners_do_not_count(frame):
    m = frame({"move_date": RECENT, "move_type": "PURCHASE"},
              {"move_date": RECENT, "partner_name": None})
    assert demand_forecast(m, AS_OF).count() == 0


def test_key_items_are_the_first_thirty(frame):
    m = frame(*[{"move_date": RECENT, "product_name": f"X{i:02d}", "qty": 10, "amount": 10 + i % 7}
                for i in range(45)])
    found = demand_forecast(m, AS_OF).collect()
    assert [r.is_key_item for r in found] == [True] * 30 + [False] * 15


def test_scenarios_equal_single_forecasts(frame):
    m = frame(*[{"move_date": dt.date(2023 + i % 2, 1 + i % 6, 1 + i % 28), "qty": i % 9,
                 "product_name": None if i % 11 == 0 else f"X{i % 5}", "amount": i * 13 % 50,
                 "partner_name": f"P{i % 3}"} for i in range(300)])
    sweep = forecast_scenarios(m, AS_OF, [1, 3], [False, True])
    for lookback in (1, 3):
        for hybrid in (False, True):
            part = sweep.where((F.col("lookback") == lookback) & (F.col("hybrid") == hybrid))
            alone = demand_forecast(m, AS_OF, lookback, hybrid)
            key = [F.col(c).cast("string") for c in alone.columns]
            assert sorted(map(str, part.select(*key).collect())) == \
                sorted(map(str, alone.select(*key).collect()))
