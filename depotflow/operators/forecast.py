"""Demand forecast per partner and product.

One pass over the outbound history computes every window as a conditional
aggregate on (partner, product). Scenarios and the separate rows of unnamed
products are unfolded after the aggregation, when the data is small.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.calendar import forecast_windows, months_between
from ..schema import OUTBOUND
from .filters import eq_filter, in_filter

KEY_ITEMS = 30
RECENT_WEIGHT, LAST_YEAR_WEIGHT = 0.4, 0.6

COLUMNS = [
    "partner_name", "product_name", "avg_recent", "last_year_qty", "current_qty",
    "unit_price", "forecast_qty", "suggested_qty", "extra_revenue", "is_key_item",
]


def demand_forecast(m, as_of, lookback=3, hybrid=False, partners=None,
                    recent_basis="row", move_type=OUTBOUND):
    """Forecast, suggested extra quantity and revenue for all partners in one job.

    `recent_basis="row"` averages the quantity of single movements, `"month"`
    averages the monthly totals. Rows without a positive forecast are left out.
    """
    result = forecast_scenarios(
        m, as_of, [lookback], [hybrid], partners, recent_basis, move_type)
    return result.drop("lookback", "hybrid").orderBy(
        "partner_name", F.desc("extra_revenue"), F.asc_nulls_last("product_name"))


def forecast_scenarios(m, as_of, lookbacks=(1, 2, 3, 4, 5, 6), hybrids=(False, True),
                       partners=None, recent_basis="row", move_type=OUTBOUND):
    """`demand_forecast` for every combination of lookback and hybrid setting."""
    metrics = _window_metrics(m, as_of, lookbacks, partners, recent_basis, move_type)
    parts = _unfold(metrics, lookbacks, hybrids)
    return _mark_key_items(_forecast(parts)).select("lookback", "hybrid", *COLUMNS)


def _window_metrics(m, as_of, lookbacks, partners, recent_basis, move_type):
    if recent_basis not in ("row", "month"):
        raise ValueError(f"recent_basis must be 'row' or 'month', not {recent_basis!r}")
    sales = eq_filter(m, "move_type", move_type).where(F.col("partner_name").isNotNull())
    sales = in_filter(sales, "partner_name", partners)
    qty, day = F.col("qty"), F.col("move_date")

    def within(window):
        return day.between(F.lit(window[0]), F.lit(window[1]))

    measures, seen = [], F.lit(False)
    for lookback in lookbacks:
        recent = forecast_windows(as_of, lookback)["recent"]
        rows = F.count(F.when(within(recent), 1))
        value = F.avg(F.when(within(recent), qty))
        if recent_basis == "month":
            value = F.sum(F.when(within(recent), qty)) / F.lit(months_between(*recent))
        measures += [rows.alias(f"rows_{lookback}"), value.alias(f"recent_{lookback}")]
    for name in ("last_year", "current"):
        window = forecast_windows(as_of, 1)[name]
        measures += [F.count(F.when(within(window), 1)).alias(f"{name}_rows"),
                     F.sum(F.when(within(window), qty)).alias(f"{name}_qty")]
    measures.append(
        F.avg(F.when(qty > 0, F.col("amount") / F.nullif(qty, F.lit(0)))).alias("price"))

    for count in _window_counts(lookbacks):
        seen = seen | (F.col(count) > 0)
    return sales.groupBy("partner_name", "product_name").agg(*measures).where(seen)


def _window_counts(lookbacks):
    return [f"rows_{n}" for n in lookbacks] + ["last_year_rows", "current_rows"]


def _unfold(metrics, lookbacks, hybrids, by=()):
    """One row per scenario and product; `by` names further keys of a forecast.

    A named product has one row when any of its windows has data. An unnamed
    product never joins with itself, so each window with data stands alone
    and has no price.
    """
    none = F.lit(None)
    named = F.col("product_name").isNotNull()
    last_year, current, price = (F.col(c) for c in ("last_year_qty", "current_qty", "price"))
    in_last_year, in_current = F.col("last_year_rows") > 0, F.col("current_rows") > 0

    def part(number, lookback, present, *values):
        types = zip(("recent", "last_year", "current", "price"), values,
                    ("double", "bigint", "bigint", "double"))
        return F.when(present, F.struct(
            F.lit(number).alias("part"), F.lit(lookback).alias("lookback"),
            *[value.cast(kind).alias(name) for name, value, kind in types]))

    parts = []
    for lookback in lookbacks:
        recent, in_recent = F.col(f"recent_{lookback}"), F.col(f"rows_{lookback}") > 0
        parts += [
            part(0, lookback, named & (in_recent | in_last_year | in_current),
                 recent, last_year, current, price),
            part(1, lookback, ~named & in_recent, recent, none, none, none),
            part(2, lookback, ~named & in_last_year, none, last_year, none, none),
            part(3, lookback, ~named & in_current, none, none, current, none),
        ]
    rows = metrics.select(*by, "partner_name", "product_name", F.inline(
        F.array_compact(F.array(*parts))))
    return rows.withColumn("hybrid", F.explode(F.array(*[F.lit(h) for h in hybrids])))


def _forecast(parts, by=()):
    """Inputs are rounded first, half away from zero; the forecast then half to even."""
    zero = F.lit(0)
    rounded = parts.select(
        *by, "lookback", "hybrid", "part", "partner_name", "product_name",
        F.round(F.coalesce("recent", zero), 1).alias("avg_recent"),
        F.coalesce("last_year", zero).cast("double").alias("last_year_qty"),
        F.coalesce("current", zero).cast("double").alias("current_qty"),
        F.round(F.coalesce("price", zero), 0).alias("unit_price"))
    blended = (F.col("avg_recent") * RECENT_WEIGHT + F.col("last_year_qty") * LAST_YEAR_WEIGHT)
    use_last_year = F.col("hybrid") & (F.col("last_year_qty") != 0)
    return (
        rounded
        .withColumn("forecast_qty", F.bround(
            F.when(use_last_year, blended).otherwise(F.col("avg_recent")), 1))
        .where(F.col("forecast_qty") > 0)
        .withColumn("suggested_qty", F.greatest(
            F.col("forecast_qty") - F.col("current_qty"), F.lit(0.0)))
        .withColumn("extra_revenue",
                    (F.col("suggested_qty") * F.col("unit_price")).cast("bigint")))


def _mark_key_items(rows, by=()):
    """Flag each partner's first 30 rows by extra revenue.

    Ranking all rows would put a large partner's whole list into one task. The
    rank limit is pruned per task instead, and the few ranked keys are joined
    back on their full key, which spreads evenly.
    """
    group = (*by, "lookback", "hybrid", "partner_name")
    order = [F.desc("extra_revenue"), F.asc_nulls_last("product_name"), F.asc("part")]
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    top = rows.withColumn("rank", rank).where(F.col("rank") <= KEY_ITEMS).select(
        *[F.col(c).alias(f"top_{c}") for c in (*group, "product_name", "part")])
    same = F.col("product_name").eqNullSafe(F.col("top_product_name"))
    for c in (*group, "part"):
        same = same & (F.col(c) == F.col(f"top_{c}"))
    return rows.join(top, same, "left").withColumn(
        "is_key_item", F.col("top_part").isNotNull())
