"""Plant KPIs and totals over the movement table."""

from pyspark.sql import functions as F

from ..functions.calendar import year_month
from ..schema import PLANTS
from .filters import date_range_filter, in_filter

MEASURES = ("total_amount", "total_qty", "invoice_count")


def _kpi_rows(m, types, plants, start, end):
    if start is None or end is None:
        raise ValueError("the KPI needs a start and an end date")
    rows = in_filter(m, "move_type", types, on_empty="error")
    rows = in_filter(rows, "plant_code", plants, on_empty="error")
    return date_range_filter(rows, start, end)


def plant_daily_kpi(m, types, plants, start, end):
    """Amount, quantity and number of distinct invoices per day and plant.

    The distinct count first groups by invoice, so a busy plant's rows are
    spread over tasks and reduced before the second, small shuffle.
    """
    return (
        _kpi_rows(m, types, plants, start, end)
        .groupBy("move_date", "plant_code")
        .agg(F.sum("amount").alias("total_amount"),
             F.sum("qty").alias("total_qty"),
             F.countDistinct("ref_no").alias("invoice_count"))
        .withColumn("year_month", year_month("move_date"))
        .orderBy(F.asc_nulls_last("move_date"), F.asc_nulls_last("plant_code")))


def plant_monthly_kpi(daily):
    """Monthly totals of the daily rows; an invoice on two days counts twice."""
    return daily.groupBy("year_month", "plant_code").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in MEASURES])


def monthly_invoices_exact(m, types, plants, start, end):
    """Invoices per month and plant, each counted once."""
    return (
        _kpi_rows(m, types, plants, start, end)
        .groupBy(year_month("move_date").alias("year_month"), "plant_code")
        .agg(F.countDistinct("ref_no").alias("invoice_count")))


def monthly_pivot(monthly, measure, plants=None):
    """One row per month, one column per plant, gaps as 0.

    The plant list is part of the call, so the columns do not depend on the
    data and no extra job looks them up. A caller's list chooses plants; without one the known
    plants are taken and any other plant is an error.
    """
    if measure not in MEASURES:
        raise ValueError(f"measure must be one of {MEASURES}")
    if not plants:
        plants = PLANTS
        unknown = F.raise_error(F.concat(F.lit("plant outside the known list: "), F.col("plant_code")))
        monthly = monthly.withColumn("plant_code", F.when(
            F.col("plant_code").isNull() | F.col("plant_code").isin(*plants), F.col("plant_code")).otherwise(unknown))
    wide = monthly.groupBy("year_month").pivot("plant_code", plants).agg(F.sum(measure))
    return wide.na.fill(0, subset=plants).orderBy("year_month")


def totals_by(m, *keys):
    """Quantity and amount per group of keys."""
    return m.groupBy(*keys).agg(
        F.sum("qty").alias("total_qty"), F.sum("amount").alias("total_amount"))


def distinct_values(m, col):
    """Sorted distinct values of a column, NULL last."""
    return m.select(col).distinct().orderBy(F.asc_nulls_last(col))
