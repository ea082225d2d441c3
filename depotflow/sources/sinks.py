"""Writing results. None of these replaces what is already there."""

from pyspark.sql import functions as F

MAX_RECORDS_PER_FILE = 5_000_000


def write_csv(df, path):
    """CSV with a header; quotes inside quoted text are doubled, as other readers expect."""
    df.write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)


def write_orders(df, path):
    df.write.mode("errorifexists").parquet(path)


def write_dispatch(detail, summary, path):
    """Detail and summary side by side.

    The detail is laid out by day, so that a reader of one day skips the other
    files; ranges over day and order also divide a very large day.
    """
    (detail.repartitionByRange("route_day", "order_id").write.mode("errorifexists")
     .parquet(f"{path}/detail"))
    summary.write.mode("errorifexists").parquet(f"{path}/summary")


def split_by_column(df, col, path, max_records=MAX_RECORDS_PER_FILE):
    """One output folder per distinct value of `col`.

    The column is kept inside the files as well. Rows are gathered by value,
    except that a value holding a large share of them is split over several
    tasks and files within its folder.
    """
    (df.withColumn(f"by_{col}", F.col(col))
     .hint("rebalance", f"by_{col}")
     .write.mode("errorifexists").option("maxRecordsPerFile", max_records)
     .partitionBy(f"by_{col}").parquet(path))
