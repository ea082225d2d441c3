"""Forecasts of many dates from running totals by month.

Every window of the forecast is a range of whole months, so a window is the
difference of two running totals. `sales_history` keeps those totals, one row
per partner and product; `forecast_dates` answers any date from it without
reading movement again.
"""

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.calendar import as_date, forecast_windows
from ..functions.once import computed_once
from ..schema import OUTBOUND
from .filters import eq_filter, in_filter
from .forecast import COLUMNS, _forecast, _mark_key_items, _unfold, _window_counts

_PRODUCT = ("partner_name", "product_name")
_TOTALS = ("rows", "qty_rows", "qty")


def _month_no(day):
    """Months since year 0, of a date or a column."""
    if isinstance(day, dt.date):
        return day.year * 12 + day.month - 1
    return F.year(day) * 12 + F.month(day) - 1


def sales_history(m, partners=None, move_type=OUTBOUND):
    """Per partner and product: first month, running totals of every month since, and the price.

    Movement is grouped by month first, inside the tasks, so a product with very many
    movements is one row a month when it is shuffled. `running[i]` holds the totals up
    to month `first_month + i`; months without movement repeat the one before. A NULL
    day belongs to no window but counts for the price. The array is as long as the history has months.
    """
    sales = eq_filter(m, "move_type", move_type).where(F.col("partner_name").isNotNull())
    sales = in_filter(sales, "partner_name", partners)
    qty, price = F.col("qty"), F.col("amount") / F.nullif(F.col("qty"), F.lit(0))
    months = sales.groupBy(*_PRODUCT, _month_no(F.col("move_date")).alias("month_no")).agg(
        F.count("*").alias("rows"), F.count("qty").alias("qty_rows"),
        F.coalesce(F.sum("qty"), F.lit(0)).alias("qty"),
        F.sum(F.when(qty > 0, price)).alias("prices"),
        F.count(F.when(qty > 0, price)).alias("priced_rows"))

    product = Window.partitionBy(*_PRODUCT, F.col("month_no").isNull()).orderBy("month_no")
    so_far = product.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = months.withColumns(
        {c: F.sum(c).over(so_far) for c in _TOTALS}
        | {"until": F.coalesce(F.lead("month_no").over(product), F.col("month_no") + 1)})
    entry = F.struct("month_no", "until", *_TOTALS)
    grouped = running.groupBy(*_PRODUCT).agg(
        F.min("month_no").alias("first_month"),
        F.array_sort(F.collect_list(F.when(F.col("month_no").isNotNull(), entry))).alias("months"),
        (F.sum("prices") / F.nullif(F.sum("priced_rows"), F.lit(0))).alias("price"))
    return grouped.select(*_PRODUCT, "first_month", "price", F.flatten(F.transform(
        "months", lambda e: F.array_repeat(
            F.struct(*[e[c].alias(c) for c in _TOTALS]), e["until"] - e["month_no"]))).alias("running"))


def forecast_dates(history, dates, lookbacks=(3,), hybrids=(False,), recent_basis="row"):
    """`forecast_scenarios` for each of `dates`, from `sales_history`, in one job.

    The result has an `as_of` column in front. Repeated dates count once; without dates there are no rows.
    """
    if recent_basis not in ("row", "month"):
        raise ValueError(f"recent_basis must be 'row' or 'month', not {recent_basis!r}")
    by, seen = ("as_of",), F.lit(False)
    each = history.select("*", F.explode(_windows(dates, lookbacks)).alias("at"))
    sums = {name: _within(f"at.{name}") for name in
            [f"recent_{n}" for n in lookbacks] + ["last_year", "current"]}
    summed = computed_once(each, {f"in_{name}": total for name, total in sums.items()})
    metrics = [F.col("at.as_of").alias("as_of"), *_PRODUCT, "price"]
    for n in lookbacks:
        total, window = F.col(f"in_recent_{n}"), F.col(f"at.recent_{n}")
        over = F.nullif(total["qty_rows"], F.lit(0)) if recent_basis == "row" else window["last"] - window["first"] + 1
        value = F.when(total["qty_rows"] > 0, total["qty"] / over)
        metrics += [total["rows"].alias(f"rows_{n}"), value.alias(f"recent_{n}")]
    for name in ("last_year", "current"):
        total = F.col(f"in_{name}")
        metrics += [total["rows"].alias(f"{name}_rows"),
                    F.when(total["qty_rows"] > 0, total["qty"]).alias(f"{name}_qty")]
    for count in _window_counts(lookbacks):
        seen = seen | (F.col(count) > 0)
    parts = _unfold(summed.select(*metrics).where(seen), lookbacks, hybrids, by)
    return _mark_key_items(_forecast(parts, by), by).select("as_of", "lookback", "hybrid", *COLUMNS)


def _windows(dates, lookbacks):
    """An array with one entry per date: the first and last month number of each window."""
    def window(span, name):
        first, last = (F.lit(_month_no(day)) for day in span)
        return F.struct(first.alias("first"), last.alias("last")).alias(name)

    entries = []
    for day in sorted({as_date(d) for d in dates}):
        recent = [window(forecast_windows(day, n)["recent"], f"recent_{n}") for n in lookbacks]
        fixed = forecast_windows(day, 1)
        entries.append(F.struct(F.lit(day).alias("as_of"), *recent, *[
            window(fixed[name], name) for name in ("last_year", "current")]))
    if not entries:
        return F.filter(_windows(["2000-01-01"], lookbacks), lambda _: F.lit(False))
    return F.array(*entries)


def _within(window):
    """Totals inside a window: those up to its last month less those before its first."""
    def up_to(month):
        place = F.least(month - F.col("first_month"), F.size("running") - 1)
        return F.when(place >= 0, F.get("running", place))

    last, before = up_to(F.col(f"{window}.last")), up_to(F.col(f"{window}.first") - 1)
    return F.struct(*[(F.coalesce(last[c], F.lit(0)) - F.coalesce(before[c], F.lit(0))).alias(c) for c in _TOTALS])
