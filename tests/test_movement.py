"""Edge cases of filters, KPIs and rankings on small frames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from depotflow.operators import filters, kpi, ranking
from depotflow.schema import MOVEMENT

DAY = dt.date(2024, 3, 5)


def move(**over):
    row = dict(move_date=DAY, move_time="10:00:00", plant_code="PLANT_0", move_type="OUTBOUND",
               storage_loc="L1", partner_name="P", partner_address="A", product_code="1",
               product_name="X", batch="B_1", qty=1, amount=10, ref_no="R1")
    return tuple((row | over)[c] for c in MOVEMENT.fieldNames())


@pytest.fixture
def frame(spark):
    return lambda *rows: spark.createDataFrame([move(**r) for r in rows], MOVEMENT)


def test_half_open_range_keeps_everything(frame):
    m = frame({}, {"move_date": dt.date(1999, 1, 1)})
    assert filters.date_range_filter(m, "2024-01-01").count() == 2
    assert filters.date_range_filter(m, None, "2024-01-01").count() == 2
    assert filters.date_range_filter(m, "2024-03-05", "2024-03-05").count() == 1


def test_time_is_missing_on_first_inner_and_last_day(frame):
    days = [dt.date(2024, 3, d) for d in (4, 5, 6, 7, 8)]
    m = frame(*[{"move_date": d, "move_time": None} for d in days])
    kept = filters.datetime_range_filter(m, "2024-03-05 08:00:00", "2024-03-07 20:00:00")
    assert [r.move_date for r in kept.collect()] == [dt.date(2024, 3, 6)]


def test_time_bounds_are_inclusive(frame):
    m = frame(*[{"move_time": t} for t in ("07:59:59", "08:00:00", "20:00:00", "20:00:01")])
    kept = filters.datetime_range_filter(m, "2024-03-05 08:00:00", "2024-03-05 20:00:00")
    assert sorted(r.move_time for r in kept.collect()) == ["08:00:00", "20:00:00"]


def test_start_must_be_before_end(frame):
    with pytest.raises(ValueError):
        filters.datetime_range_filter(frame({}), "2024-03-05 08:00:00", "2024-03-05 08:00:00")


@pytest.mark.parametrize("text, expected", [
    ("_", {"A_1", "A1%", "A\\1", "AX1"}),
    ("A_1", {"A_1", "A\\1", "AX1"}),
    ("1%", {"A_1", "A1%", "A\\1", "AX1"}),
    ("\\", {"A\\1"}),
    ("", {"A_1", "A1%", "A\\1", "AX1"}),
])
def test_like_wildcards(frame, text, expected):
    m = frame(*[{"batch": b} for b in ("A_1", "A1%", "A\\1", "AX1")])
    assert {r.batch for r in filters.like_filter(m, "batch", text).collect()} == expected


def test_empty_lists(frame):
    m = frame({}, {"plant_code": "PLANT_1"})
    assert filters.in_filter(m, "plant_code", []).count() == 2
    with pytest.raises(ValueError):
        filters.in_filter(m, "plant_code", [], on_empty="error")
    with pytest.raises(ValueError):
        kpi.plant_daily_kpi(m, [], ["PLANT_0"], DAY, DAY)
    with pytest.raises(ValueError):
        kpi.plant_daily_kpi(m, ["OUTBOUND"], ["PLANT_0"], DAY, None)


def test_list_values_compare_as_text(frame):
    m = frame({"qty": 7}, {"qty": 8})
    assert filters.in_filter(m, "qty", [7, "9"]).count() == 1


def test_search_is_newest_first_and_capped(frame):
    m = frame({"move_time": None}, {"move_time": "09:00:00"}, {"move_date": dt.date(2024, 3, 6)})
    found = [(r.move_date.day, r.move_time) for r in filters.search_movements(m).collect()]
    assert found == [(6, "10:00:00"), (5, "09:00:00"), (5, None)]
    assert filters.search_movements(m, limit=2).count() == 2


def test_invoice_on_two_days_counts_twice_by_month(frame):
    m = frame({}, {"move_date": dt.date(2024, 3, 6)}, {"amount": None, "qty": None})
    args = (m, ["OUTBOUND"], ["PLANT_0"], "2024-03-01", "2024-03-31")
    monthly = kpi.plant_monthly_kpi(kpi.plant_daily_kpi(*args)).collect()
    assert [(r.total_amount, r.total_qty, r.invoice_count) for r in monthly] == [(20, 2, 2)]
    assert kpi.monthly_invoices_exact(*args).collect()[0].invoice_count == 1


def test_missing_sums_count_as_zero(frame):
    m = frame({"amount": None, "qty": None})
    daily = kpi.plant_daily_kpi(m, ["OUTBOUND"], ["PLANT_0"], DAY, DAY)
    assert kpi.plant_monthly_kpi(daily).collect()[0].total_amount == 0


def test_pivot_has_a_column_per_asked_plant(frame):
    m = frame({})
    daily = kpi.plant_daily_kpi(m, ["OUTBOUND"], ["PLANT_0", "PLANT_9"], DAY, DAY)
    wide = kpi.monthly_pivot(
        kpi.plant_monthly_kpi(daily), "total_qty", ["PLANT_0", "PLANT_9"]).collect()
    assert [r.asDict() for r in wide] == [{"year_month": "2024-03", "PLANT_0": 1, "PLANT_9": 0}]


def test_rank_ties_go_by_key(frame):
    m = frame(*[{"product_code": c, "product_name": n, "amount": 5}
                for c, n in (("2", "b"), ("1", None), ("1", "a"))])
    top = ranking.top_products(m, "OUTBOUND", "PLANT_0", n=2).collect()
    assert [(r.product_code, r.product_name) for r in top] == [("1", "a"), ("1", None)]


def test_rank_by_plant_equals_rank_of_each_plant(frame):
    m = frame(*[{"plant_code": f"PLANT_{i % 2}", "product_code": str(i % 17), "amount": i * 7 % 23}
                for i in range(200)])
    together = ranking.top_products_by_plant(m, n=4)
    for plant in ("PLANT_0", "PLANT_1"):
        alone = ranking.top_products(m, "OUTBOUND", plant, n=4).collect()
        here = together.where(F.col("plant_code") == plant).orderBy("rank").collect()
        assert [r.product_code for r in here] == [r.product_code for r in alone]


def test_limit_rows(frame):
    m = frame({"qty": 3}, {"qty": 1}, {"qty": 2})
    assert [r.qty for r in filters.limit_rows(m, 2, "qty").collect()] == [1, 2]
    assert filters.limit_rows(m).count() == 3
    with pytest.raises(ValueError):
        filters.limit_rows(m, 2)
