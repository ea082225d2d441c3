"""Stock cleaning, totals and counting sheets."""

from pyspark.sql import functions as F

from ..schema import STAGING_LOCATION

SIGN_OFF = ("counted_by", "keyed_by", "approved_by")
FORMS = ("full", "upload", "daily")


def clean_stock(stock, staging=STAGING_LOCATION):
    """Drops staging locations; rows without a location stay."""
    return stock.where(~F.coalesce(F.contains("storage_loc", F.lit(staging)), F.lit(False)))


def dedupe_stock(stock):
    return stock.dropDuplicates()


def stock_by_product(stock):
    return stock.groupBy("product_code").agg(F.sum("qty").alias("qty"))


def stock_sheet(stock, form):
    """Cleaned stock by location, in one of three layouts.

    full: every column and empty sign-off columns; upload: code, location and
    quantity; daily: location, code, name and quantity.
    """
    if form not in FORMS:
        raise ValueError(f"form must be one of {FORMS}, not {form!r}")
    rows = dedupe_stock(clean_stock(stock))
    order = ["storage_loc", "product_code"]
    if form == "full":
        order += [c for c in stock.columns if c not in order]
        sheet = rows.select(*stock.columns, *[F.lit("").alias(c) for c in SIGN_OFF])
    elif form == "upload":
        sheet = rows.groupBy(*order).agg(F.sum("qty").alias("qty")).select(
            "product_code", "storage_loc", "qty")
    else:
        order.append("product_name")
        sheet = rows.groupBy(*order).agg(F.sum("qty").alias("qty"))
    return sheet.orderBy(*[F.asc_nulls_last(c) for c in order])
