"""Shaping delivery sheets on the way in."""

from pyspark.sql import functions as F

from ..schema import NAME_COLUMNS


def normalise_headers(df, mapping):
    """Renames the headers that occur; others stay."""
    return df.withColumnsRenamed(mapping)


def detect_name_column(df, candidates=NAME_COLUMNS, row="row_no"):
    """Adds `customer_name` from the first column, in file order, that is a candidate.

    Without one, rows are called order_1, order_2, .. after the 0-based `row` column.
    """
    for column in df.columns:
        if column in candidates:
            return df.withColumn("customer_name", F.col(column).cast("string"))
    return df.withColumn(
        "customer_name", F.concat(F.lit("order_"), (F.col(row) + 1).cast("string")))
