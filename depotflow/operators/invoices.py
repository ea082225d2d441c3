"""Distinct invoices of any set of days and plants from mergeable exact bitmaps."""

import datetime as dt

from pyspark.sql import functions as F

from ..functions.calendar import as_date

# Bits of one bitmap of the built-in aggregates; ids are dense, so a bitmap holds as many neighbouring invoices.
KEYS = ("move_date", "plant_code", "move_type")
# Bitmaps of one file: 16 MB in memory, however little their zeros take on disk.
FILE_ROWS = 4_096


def _dealt(rows, *keys, times=1):
    """Rows by key in a stated number of partitions: merged by their compressed bytes, bitmaps would fill a task's memory."""
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(times * partitions, *keys)


def number_invoices(m):
    """(ref_no, invoice_id): every invoice with a whole number, in order of its first day.

    Numbers follow each other inside a partition, so the invoices of a day share few bitmaps. Write the
    result before use: numbers belong to this table and would be dealt anew by another run.
    """
    first = m.where(F.col("ref_no").isNotNull()).groupBy("ref_no").agg(F.min("move_date").alias("first_day"))
    ordered = first.repartitionByRange("first_day", "ref_no").sortWithinPartitions("first_day", "ref_no")
    return ordered.select("ref_no", F.monotonically_increasing_id().alias("invoice_id"))


def invoice_bitmaps(m, numbers, keys=KEYS):
    """One bitmap of invoices for each combination of `keys` and bucket of neighbouring numbers, 4 KB at most.

    Rows are reduced to distinct (keys, invoice) before they meet the numbers, so a busy day spreads over its invoices.
    """
    once = m.where(F.col("ref_no").isNotNull()).groupBy(*keys, "ref_no").agg(F.lit(1).alias("one"))
    placed = once.join(numbers, "ref_no").select(
        *keys, F.bitmap_bucket_number("invoice_id").alias("bucket"), F.bitmap_bit_position("invoice_id").alias("position"))
    # Positions are dealt and sorted, not bitmaps of each task, which are 4 KB for a few positions.
    return _dealt(placed, *keys, "bucket").groupBy(*keys, "bucket").agg(F.bitmap_construct_agg("position").alias("bits"))


def write_bitmaps(bitmaps, path):
    """Written in files of so few rows that a task which reads several of them holds a bounded number of bitmaps."""
    bitmaps.write.option("maxRecordsPerFile", FILE_ROWS).parquet(path)
    return bitmaps.sparkSession.read.schema(bitmaps.schema).parquet(path)


def _merged(bitmaps, *named):
    rows = bitmaps.select(*named, "bucket", "bits")
    names = [c for c in rows.columns if c not in ("bucket", "bits")]
    return _dealt(rows, *names, "bucket", times=4).groupBy(*names, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def count_invoices(bitmaps, *keys):
    """Distinct invoices for each combination of `keys`, columns or expressions over the bitmaps' keys."""
    named = [F.col(k) if isinstance(k, str) else k for k in keys]
    merged = _merged(bitmaps, *named)
    names = [c for c in merged.columns if c not in ("bucket", "bits")]
    return merged.groupBy(*names).agg(F.sum(F.bitmap_count("bits")).alias("invoice_count"))


def count_invoices_in_ranges(bitmaps, ranges):
    """(range_name, invoice_count) for inclusive date ranges [(name, start, end)], overlapping or not, in one job.

    The ends of all ranges cut time into spans. Bitmaps are merged inside each span first, and only these
    are repeated for the ranges that hold the span; a range without invoices counts 0.
    """
    spans = sorted({as_date(a) for _, a, _ in ranges} | {as_date(b) + dt.timedelta(days=1) for _, _, b in ranges})
    begun = F.filter(F.array(*map(F.lit, spans)), lambda day: day <= F.col("move_date"))
    inside = _merged(bitmaps.where(F.col("move_date") >= spans[0]), F.array_max(begun).alias("span"))
    listed = F.array(*[F.struct(F.lit(n).alias("range_name"), F.lit(as_date(a)).alias("a"), F.lit(as_date(b)).alias("b"))
                       for n, a, b in ranges])
    held = F.explode(F.filter(listed, lambda r: F.col("span").between(r["a"], r["b"]))).alias("r")
    counted = count_invoices(inside.select(held, "bucket", "bits").select("r.range_name", "bucket", "bits"), "range_name")
    names = bitmaps.sparkSession.createDataFrame([(n,) for n, _, _ in ranges], "range_name string")
    return names.join(counted, "range_name", "left").select(
        "range_name", F.coalesce("invoice_count", F.lit(0)).alias("invoice_count"))
