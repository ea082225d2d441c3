"""Purchase returns: scanned counts against the return list and the stock."""

from pyspark.sql import functions as F

KEY = ["gtin", "batch"]


def match_counts(counts, return_list, stock):
    """Joins scanned counts per (gtin, batch) with expected and stocked quantities.

    Each side is reduced to one row per key before it is joined, so a product
    with very many scans is one row by then.
    """
    expected = return_list.groupBy(*KEY).agg(F.sum("expected_qty").alias("expected_qty"))
    stocked = stock.groupBy(*KEY).agg(F.sum("qty").alias("stock_qty"))
    scanned = F.coalesce("scanned_qty", F.lit(0))
    status = (
        F.when(F.col("expected_qty").isNull(), "NOT_LISTED")
        .when(F.col("scanned_qty") >= F.col("expected_qty"), "COMPLETE")
        .otherwise("OPEN"))
    return (
        expected.join(counts, KEY, "full_outer").join(stocked, KEY, "left")
        .withColumn("scanned_qty", scanned).withColumn("status", status)
        .select(*KEY, "expected_qty", "scanned_qty", "stock_qty", "status"))


def match_returns(scans, return_list, stock):
    """Return lines with their scanned and stocked quantity, and unlisted scans.

    `scans` has the extracted GS1 fields; scans without a product code or batch
    cannot match a line: `unmatched_scans` reports them.
    """
    usable = scans.where(F.col("gtin").isNotNull() & F.col("batch").isNotNull())
    counts = usable.groupBy(*KEY).agg(F.count("*").alias("scanned_qty"))
    return match_counts(counts, return_list, stock)


def unmatched_scans(scans):
    """Scans that no return line can match, with the reason; with the counted ones these are all scans."""
    reason = F.when(F.col("gtin").isNull(), "NO_PRODUCT_CODE").when(F.col("batch").isNull(), "NO_BATCH")
    return scans.withColumn("reason", reason).where(F.col("reason").isNotNull())


def completed_returns(matched):
    """Listed lines scanned in full."""
    return matched.where(
        F.col("expected_qty").isNotNull() & (F.col("scanned_qty") >= F.col("expected_qty")))


def open_returns(return_list, completed):
    """Lines of the return list that are not completed."""
    return return_list.join(completed.select(*KEY), KEY, "left_anti")
