"""Predicates and searches over the movement table."""

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.calendar import as_date
from ..functions.text import like_text
from ..schema import OUTBOUND, SEARCH_COLS, SHIPMENT_COLS


def _in_days(m, start, end):
    """Date condition; on a landed table also the months, so that partitions are skipped."""
    condition = F.col("move_date").between(F.lit(start), F.lit(end))
    if "move_month" in m.columns:
        condition &= F.col("move_month").between(f"{start:%Y-%m}", f"{end:%Y-%m}")
    return condition


def date_range_filter(m, start=None, end=None):
    """Inclusive date range. A missing bound means the whole history."""
    if start is None or end is None:
        return m
    return m.where(_in_days(m, as_date(start), as_date(end)))


def in_filter(m, col, values, on_empty="skip"):
    """Membership in a list, compared as text.

    An empty list keeps every row (`on_empty="skip"`) or is refused ("error").
    """
    if on_empty not in ("skip", "error"):
        raise ValueError(f"on_empty must be 'skip' or 'error', not {on_empty!r}")
    values = [str(v) for v in values or []]
    if not values:
        if on_empty == "error":
            raise ValueError(f"choose at least one value for {col}")
        return m
    column = F.col(col)
    if m.schema[col].dataType.typeName() != "string":
        column = column.cast("string")
    return m.where(column.isin(values))


def like_filter(m, col, text=None):
    """Substring match; no text means no filter."""
    return m.where(like_text(col, text)) if text else m


def eq_filter(m, col, value=None):
    """Exact match; no value means no filter."""
    return m if value is None else m.where(F.col(col) == F.lit(value))


def datetime_range_filter(m, start_dt, end_dt):
    """Rows from start to end, both included, over separate date and time columns.

    A NULL time is dropped on the first and last day and kept in between. The
    plain date range is implied; it is stated so that it reaches the scan.
    """
    start_dt, end_dt = (
        dt.datetime.fromisoformat(v) if isinstance(v, str) else v for v in (start_dt, end_dt))
    if start_dt >= end_dt:
        raise ValueError(f"start {start_dt} must be before end {end_dt}")
    day, time = F.col("move_date"), F.col("move_time")
    first, last = F.lit(start_dt.date()), F.lit(end_dt.date())
    from_time, to_time = (F.lit(v.strftime("%H:%M:%S")) for v in (start_dt, end_dt))
    return m.where(
        _in_days(m, start_dt.date(), end_dt.date())
        & ((day > first) | (time >= from_time))
        & ((day < last) | (time <= to_time)))


def search_rows(m, start=None, end=None, plants=None, move_types=None, batch=None, ref_no=None, partner=None, product=None):
    """Rows that meet all given conditions."""
    found = date_range_filter(m, start, end)
    found = in_filter(found, "plant_code", plants)
    found = in_filter(found, "move_type", move_types)
    found = like_filter(found, "batch", batch)
    found = like_filter(found, "ref_no", ref_no)
    found = eq_filter(found, "partner_name", partner)
    return eq_filter(found, "product_name", product)


def _newest_first():
    return [F.desc_nulls_last("move_date"), F.desc_nulls_last("move_time"), *[F.asc_nulls_last(c) for c in SEARCH_COLS[2:]]]


def search_movements(m, start=None, end=None, plants=None, move_types=None, batch=None,
                     ref_no=None, partner=None, product=None, limit=None):
    """All given conditions together, newest first, all rows or the first `limit`; see `newest_movements` for landed tables."""
    found = search_rows(m, start, end, plants, move_types, batch, ref_no, partner, product)
    found = found.select(*SEARCH_COLS).orderBy(*_newest_first())
    return found if limit is None else found.limit(limit)


def newest_movements(m, n, **filters):
    """The newest `n` rows of a landed table that meet the conditions of `search_movements`, as that orders them.

    Matching rows are counted per month first, reading only the columns of the conditions. From the newest
    month back, only the months up to `n` rows are read again; of these the days, and of these the seconds, are cut
    alike. So what is sorted at the end is `n` rows and those of one second, whatever the table holds, and no
    task hands `n` rows to another. Rows without a date come last.
    """
    if n < 1:
        raise ValueError("n must be 1 or more")
    found = search_rows(m, **filters)
    month = F.coalesce("move_month", F.lit(""))
    # text of equal length, so that it sorts as day and time do; no date or no time comes first
    day = F.coalesce(F.date_format("move_date", "yyyy-MM-dd"), F.lit(""))
    second = F.concat(day, F.lit(" "), F.coalesce("move_time", F.lit("")))
    for key in (month, day, second):
        found = found.where(key >= _last_needed(found, key, n))
    return found.select(*SEARCH_COLS).orderBy(*_newest_first()).limit(n)


def _last_needed(rows, key, n):
    """The largest key so that rows from it on number `n` or more, else the smallest; one value.

    Callers narrow the rows first, so that the counts ordered here are few: months, days of the months
    kept, then seconds of the days kept.
    """
    counts = rows.groupBy(key.alias("k")).agg(F.count("*").alias("n"))
    newer = F.sum("n").over(Window.orderBy(F.desc("k")))
    return counts.withColumn("reached", newer).agg(
        F.coalesce(F.max(F.when(F.col("reached") >= n, F.col("k"))), F.min("k"))).scalar()


def outbound_shipments(m, plant, start_dt, end_dt, move_type=OUTBOUND):
    """Shipments of one plant between two points in time, oldest first."""
    found = datetime_range_filter(m, start_dt, end_dt)
    found = eq_filter(eq_filter(found, "move_type", move_type), "plant_code", plant)
    return found.select(*SHIPMENT_COLS).orderBy(*[F.asc_nulls_last(c) for c in SHIPMENT_COLS])


def limit_rows(df, n=None, order_by=()):
    """The first `n` rows in key order; no cap when `n` is None."""
    if n is None:
        return df
    if not order_by:
        raise ValueError("a cap needs an order")
    keys = [order_by] if isinstance(order_by, str) else order_by
    return df.orderBy(*[F.asc_nulls_last(k) for k in keys]).limit(n)
