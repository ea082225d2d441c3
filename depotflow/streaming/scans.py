"""Scan streams. Every query takes its checkpoint folder from the caller."""

from pyspark.sql import functions as F

from ..operators.returns import KEY, match_counts
from ..operators.scans import classify_scans, extract_gs1


def classify_stream(scans, path, checkpoint):
    """Classified scans appended to Parquet, exactly once, until the input is used up."""
    return (
        classify_scans(scans).writeStream.outputMode("append").format("parquet")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start())


def count_stream(scans):
    """Running number of scans per (gtin, batch). State is one counter per key.

    The counter is a built-in aggregate, so scans of a busy product are counted
    inside each task before they meet in the state store.
    """
    usable = extract_gs1(scans).where(F.col("gtin").isNotNull() & F.col("batch").isNotNull())
    return usable.groupBy(*KEY).agg(F.count("*").alias("scanned_qty"))


def match_returns_stream(scans, return_list, path, checkpoint):
    """Return lines touched by each batch of scans, with their running count.

    Updates are written per batch under their batch number, so a batch repeated
    after a failure replaces itself.
    """
    expected = return_list.groupBy(*KEY).agg(F.sum("expected_qty").alias("expected_qty"))
    matched = (
        count_stream(scans).join(expected, KEY, "left")
        .withColumn("status", F.when(F.col("expected_qty").isNull(), "NOT_LISTED")
                    .when(F.col("scanned_qty") >= F.col("expected_qty"), "COMPLETE")
                    .otherwise("OPEN")))

    def save(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (
        matched.writeStream.outputMode("update").foreachBatch(save)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def latest_matches(spark, path):
    """The last state of every key written by `match_returns_stream`."""
    updates = spark.read.parquet(path)
    columns = [c for c in updates.columns if c not in (*KEY, "batch_id")]
    last = F.max_by(F.struct(*columns), "batch_id").alias("last")
    return updates.groupBy(*KEY).agg(last).select(*KEY, "last.*")


def match_with_stock(matches, return_list, stock):
    """The batch report over the counts of a stream."""
    return match_counts(matches.select(*KEY, "scanned_qty"), return_list, stock)
