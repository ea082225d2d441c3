"""Top products and partners by amount."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..schema import OUTBOUND, PURCHASE, RETURN
from .filters import date_range_filter, eq_filter, in_filter
from .kpi import totals_by

PRODUCT = ("product_code", "product_name")
PARTNER = ("partner_name",)


def _order(keys):
    return [F.desc_nulls_last("total_amount"), *[F.asc_nulls_last(k) for k in keys]]


def _top(m, keys, move_type, plant, start, end, n):
    rows = eq_filter(eq_filter(m, "move_type", move_type), "plant_code", plant)
    return totals_by(date_range_filter(rows, start, end), *keys).orderBy(*_order(keys)).limit(n)


def top_products(m, move_type, plant, start=None, end=None, n=30):
    return _top(m, PRODUCT, move_type, plant, start, end, n)


def top_partners(m, move_type, plant, start=None, end=None, n=10):
    return _top(m, PARTNER, move_type, plant, start, end, n)


def _top_by_plant(m, keys, types, plants, start, end, n):
    # The rank filter is pruned inside each task before rows move to their plant.
    groups = ("plant_code", "move_type")
    rows = in_filter(in_filter(m, "move_type", types), "plant_code", plants)
    totals = totals_by(date_range_filter(rows, start, end), *groups, *keys)
    rank = F.row_number().over(Window.partitionBy(*groups).orderBy(*_order(keys)))
    return totals.withColumn("rank", rank).where(F.col("rank") <= n)


def top_products_by_plant(m, types=(OUTBOUND, PURCHASE), plants=None, start=None, end=None, n=30):
    """`top_products` for every plant and movement type in one job."""
    return _top_by_plant(m, PRODUCT, types, plants, start, end, n)


def top_partners_by_plant(m, types=(OUTBOUND, RETURN), plants=None, start=None, end=None, n=10):
    """`top_partners` for every plant and movement type in one job."""
    return _top_by_plant(m, PARTNER, types, plants, start, end, n)
