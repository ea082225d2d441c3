"""Returns desk on a stream: sessions that end, and scans that came after their end."""

from pyspark.sql import functions as F

from ..operators.returns import KEY, match_counts
from ..operators.scans import extract_gs1

SESSION = ["operator_id", "session_start", "session_end", *KEY]


def _counted(scans, length, delay=None):
    usable = extract_gs1(scans).where(F.col("gtin").isNotNull() & F.col("batch").isNotNull())
    usable = usable.withColumn("at", F.col("scan_ts").cast("timestamp"))
    if delay:
        usable = usable.withWatermark("at", delay)
    counted = usable.groupBy("operator_id", F.window("at", length).alias("session"), *KEY).agg(F.count("*").alias("scanned_qty"))
    return counted.select("operator_id", F.col("session.start").alias("session_start"), F.col("session.end").alias("session_end"), *KEY, "scanned_qty")


def return_sessions(scans, length="1 day"):
    """Scans per desk (operator), session and (gtin, batch). Sessions are periods of `length`; scans without a time have none."""
    return _counted(scans, length)


def close_sessions_stream(scans, path, checkpoint, length="1 day", delay="1 day", **trigger):
    """Appends every session once, as a whole, when its time is over; runs until the input is used up unless told otherwise.

    A session ends when the newest scan is `delay` past its end. Its counters, one for each (gtin, batch) with scans
    counted inside the tasks first, then leave the state, so the state holds open sessions only, however long
    the stream runs; nothing that is written is written again. Scans of sessions that have ended are not
    counted: see `late_scans`. For large states choose the RocksDB provider for the session.
    """
    return (
        _counted(scans, length, delay).writeStream.outputMode("append").format("parquet")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start())


def late_scans(scans, closed, length="1 day"):
    """Per session and (gtin, batch) the scans that came after the session had ended, from all landed scans.

    What a closed session lacks against the scans is late. Sessions count as ended up to the end of the last
    closed one. Counted, late and still open scans together are all usable scans.
    """
    last = closed.agg(F.max("session_end")).scalar()
    ended = return_sessions(scans, length).where(F.col("session_end") <= last).withColumnRenamed("scanned_qty", "all_qty")
    missing = F.col("all_qty") - F.coalesce("scanned_qty", F.lit(0))
    return ended.join(closed, SESSION, "left").withColumn("late_qty", missing).where("late_qty > 0").select(*SESSION, "late_qty")


def match_closed_sessions(closed, return_list, stock):
    """The returns report over all closed sessions."""
    return match_counts(closed.groupBy(*KEY).agg(F.sum("scanned_qty").alias("scanned_qty")), return_list, stock)
