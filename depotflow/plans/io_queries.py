"""Queries that write a table and read it back, and queries that run as streams."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.calendar import month_range
from ..operators import dispatch, invoices
from ..operators.filters import date_range_filter, newest_movements
from ..operators.returns import KEY
from ..schema import MOVE_TYPE_LABELS, MOVEMENT_HEADERS, NAME_COLUMNS, OUTBOUND, PURCHASE, SCAN
from ..session import fresh_path
from ..sources import movement, sinks, tables
from ..streaming import scans as streams
from ..streaming import sessions
from .dispatch_queries import DELIVERY, PLAN, _rounded, whole_fleet
from .movement_queries import SEARCH_SQL
from .workflows import dispatch_plan
from .registry import query, sql_with
from .scan_queries import CLASSIFIED, EXTRACTED, FIXED

# Micro-batches that the stream queries run in, least files of each, and most scans of a file if there are more files.
BATCHES, BATCH_FILES = 5, 4
FILE_SCANS = 100_000
SALES_HEADERS = {"거래처명": "name", "주소": "address", "박스수량": "box_qty", "봉지수량": "bag_qty"}


@query("land_movement", "S1 S2", sql_with(
    ["movement"], "SELECT *, strftime(move_date, '%Y-%m') AS move_month FROM movement"))
def _(t):
    path = fresh_path(t.spark, "movement")
    movement.land_movement(t.movement, path)
    return movement.read_movement(t.spark, path)


@query("landed_month", "S1 S2 P8", sql_with(["movement"], """
SELECT *, strftime(move_date, '%Y-%m') AS move_month FROM movement
WHERE YEAR(move_date) = 2000 AND MONTH(move_date) = 6"""))
def _(t):
    path = fresh_path(t.spark, "movement")
    movement.land_movement(t.movement, path)
    landed = movement.read_movement(t.spark, path)
    return date_range_filter(landed, *month_range(2000, 6))


@query("standardise_movement", "S2 S3", sql_with(["movement"], "SELECT * FROM movement"))
def _(t):
    extract = t.movement.withColumnsRenamed({v: k for k, v in MOVEMENT_HEADERS.items()})
    labels = {code: label for label, code in MOVE_TYPE_LABELS.items()}
    return movement.standardise_movement(extract.replace(labels, subset=["Move_Desc"]))


@query("normalise_headers", "S3", sql_with(["delivery_orders"], "SELECT * FROM delivery_orders"))
def _(t):
    sheet = t.delivery_orders.withColumnsRenamed({v: k for k, v in SALES_HEADERS.items()})
    return tables.normalise_headers(sheet, SALES_HEADERS)


@query("detect_name_column", "S4", sql_with(
    ["delivery_orders"], "SELECT *, name AS customer_name FROM delivery_orders"))
def _(t):
    return tables.detect_name_column(t.delivery_orders, NAME_COLUMNS, "order_id")


@query("default_names", "S4", sql_with(["delivery_orders"], """
SELECT order_id, 'order_' || CAST(order_id + 1 AS VARCHAR) AS customer_name FROM delivery_orders"""))
def _(t):
    return tables.detect_name_column(t.delivery_orders.select("order_id"), row="order_id")


@query("write_csv", "S2 S3 S5 X9", sql_with(["movement"], "SELECT * FROM movement"))
def _(t):
    """The whole table as an extract with foreign headers, labels and timestamps, read back."""
    path = fresh_path(t.spark, "extract")
    labels = {code: label for label, code in MOVE_TYPE_LABELS.items()}
    extract = t.movement.withColumn("move_date", F.date_format("move_date", "yyyy-MM-dd HH:mm:ss"))
    sinks.write_csv(extract.replace(labels, subset=["move_type"]).withColumnsRenamed(
        {v: k for k, v in MOVEMENT_HEADERS.items()}), path)
    return movement.read_extract(t.spark, path)


@query("write_dispatch", "S6", sql_with(DELIVERY, f"""
SELECT s.route_day, s.vehicle_id, s.stops, ROUND(s.km, 6) AS km, d.located_orders
FROM summary s JOIN (SELECT route_day, COUNT(*) AS located_orders FROM points
                     WHERE lat IS NOT NULL GROUP BY route_day) d USING (route_day)""",
    PLAN, recursive=True))
def _(t):
    path = fresh_path(t.spark, "dispatch")
    dispatch_plan(t.delivery_orders, whole_fleet(t), t.vehicle_zone, path)
    days = t.spark.read.parquet(f"{path}/detail").groupBy("route_day").agg(
        F.count("vehicle_id").alias("located_orders"))
    summary = t.spark.read.parquet(f"{path}/summary")
    # days are few against the summary's rows, a vehicle and day each, which need no shuffle so
    return _rounded(summary.join(F.broadcast(days), "route_day").select(
        "route_day", "vehicle_id", "stops", "km", "located_orders"), "km")


@query("split_by_column", "S7", sql_with(["movement"], """
SELECT *, partner_name AS by_partner_name FROM movement"""))
def _(t):
    path = fresh_path(t.spark, "split")
    sinks.split_by_column(t.movement, "partner_name", path)
    return t.spark.read.parquet(path)


@query("write_orders", "S8", sql_with(["delivery_orders", "geo_reference"], """
SELECT o.* EXCLUDE (coord, box_qty, bag_qty),
       CASE WHEN trim(o.address) = '' THEN 'NO_ADDRESS'
            WHEN g.coord IS NULL THEN 'NOT_FOUND' ELSE g.coord END AS coord,
       COALESCE(box_qty, 0) AS box_qty, COALESCE(bag_qty, 0) AS bag_qty,
       COALESCE(box_qty, 0) + COALESCE(bag_qty, 0) * CAST(0.2 AS DOUBLE) AS total_load
FROM delivery_orders o LEFT JOIN geo_reference g ON o.address = g.address"""))
def _(t):
    path = fresh_path(t.spark, "orders")
    geocoded = dispatch.geocode_orders(t.delivery_orders, t.geo_reference)
    sinks.write_orders(dispatch.with_total_load(geocoded), path)
    return t.spark.read.parquet(path)


def _scan_stream(t):
    """The scan table landed once, then read back as a stream of files in several micro-batches, each for all cores."""
    path = fresh_path(t.spark, "scans")
    files = max(BATCH_FILES, t.spark.sparkContext.defaultParallelism)
    t.scans.repartition(BATCHES * files).write.parquet(path)
    return t.spark.readStream.schema(SCAN).option("maxFilesPerTrigger", files).parquet(path)


@query("classify_stream", "D1", sql_with(["scans"], "SELECT * FROM classified", [CLASSIFIED]))
def _(t):
    path = fresh_path(t.spark, "classified")
    streams.classify_stream(
        _scan_stream(t), path, fresh_path(t.spark, "checkpoint")).awaitTermination()
    return t.spark.read.parquet(path)


@query("match_returns_stream", "J7", sql_with(["scans", "return_list"], """
SELECT c.gtin, c.batch, c.n AS scanned_qty, r.expected_qty,
       CASE WHEN r.expected_qty IS NULL THEN 'NOT_LISTED'
            WHEN c.n >= r.expected_qty THEN 'COMPLETE' ELSE 'OPEN' END AS status
FROM (SELECT gtin, batch, COUNT(*) AS n FROM extracted
      WHERE gtin IS NOT NULL AND batch IS NOT NULL GROUP BY ALL) c
LEFT JOIN return_list r ON r.gtin = c.gtin AND r.batch = c.batch""", [FIXED, EXTRACTED]))
def _(t):
    path = fresh_path(t.spark, "matches")
    streams.match_returns_stream(
        _scan_stream(t), t.return_list, path,
        fresh_path(t.spark, "checkpoint")).awaitTermination()
    return streams.latest_matches(t.spark, path).select(
        *KEY, "scanned_qty", "expected_qty", "status")


def _scans_by_year(t, years):
    """The scan table landed year after year in the given order, and a stream with a micro-batch a year. The first and last year have all before and after.

    The table is built once and kept by year; the files of a year grow in number with the table.
    """
    path, by_year = fresh_path(t.spark, "scans"), fresh_path(t.spark, "scans-by-year")
    year = F.greatest(F.lit(min(years)), F.least(F.lit(max(years)), F.year("scan_ts")))
    t.scans.withColumn("year", year).write.partitionBy("year").parquet(by_year)
    kept = t.spark.read.schema(T.StructType([*SCAN.fields, T.StructField("year", T.IntegerType())])).parquet(by_year)
    files = max(BATCH_FILES, kept.count() // (len(years) * FILE_SCANS))
    for y in years:
        kept.where(F.col("year") == y).drop("year").repartition(files).write.mode("append").parquet(path)
    return path, t.spark.readStream.schema(SCAN).option("maxFilesPerTrigger", files).parquet(path)


def _closed(t, years):
    landed, stream = _scans_by_year(t, years)
    path = fresh_path(t.spark, "sessions")
    sessions.close_sessions_stream(stream, path, fresh_path(t.spark, "checkpoint")).awaitTermination()
    return t.spark.read.schema(SCAN).parquet(landed), t.spark.read.parquet(path)


SESSIONS = """sessions AS (
  SELECT operator_id, CAST(scan_ts AS DATE) AS session_day, gtin, batch, COUNT(*) AS scanned_qty
  FROM extracted WHERE gtin IS NOT NULL AND batch IS NOT NULL AND scan_ts IS NOT NULL GROUP BY ALL)"""


@query("return_sessions_stream", "J7", sql_with(["scans"], """
SELECT * FROM sessions WHERE session_day <= (SELECT MAX(session_day) FROM sessions) - 2""", [FIXED, EXTRACTED, SESSIONS]))
def _(t):
    """Years come in order, so nothing is late; the newest two days are still open."""
    _, closed = _closed(t, range(1995, 2002))
    return closed.withColumn("session_day", F.to_date("session_start")).drop("session_start", "session_end")


@query("late_return_scans", "J7", sql_with(["scans"], """
SELECT operator_id, session_day, gtin, batch, scanned_qty AS late_qty FROM sessions
WHERE YEAR(session_day) = 1997""", [FIXED, EXTRACTED, SESSIONS]))
def _(t):
    """1997 comes when 1998 has ended, so all of it is late."""
    late = sessions.late_scans(*_closed(t, [1995, 1996, 1998, 1999, 1997, 2000, 2001]))
    return late.withColumn("session_day", F.to_date("session_start")).drop("session_start", "session_end")


@query("land_corrected", "S2", sql_with(
    ["movement"], "SELECT *, strftime(move_date, '%Y-%m') AS move_month FROM movement"))
def _(t):
    """A first extract with wrong rows and gaps, a second that corrects it, both landed again, the older one last."""
    # The source that both extracts are cut from, built once.
    source = fresh_path(t.spark, "source")
    t.large("movement").write.parquet(source)
    rows = movement.read_movement(t.spark, source, landed=False)
    number = F.substring("ref_no", 4, 20).cast("long")
    wrong = rows.where(number % 7 != 0).withColumn(
        "move_date", F.when(number % 5 == 0, F.add_months("move_date", 1)).otherwise(F.col("move_date"))).withColumn(
        "amount", F.when(number % 5 == 0, F.col("amount") + 1000).otherwise(F.col("amount")))
    right = rows.where((number % 5 == 0) | (number % 7 == 0))
    path = fresh_path(t.spark, "extracts")
    for extract_no, extract in ((1, wrong), (2, right), (2, right), (1, wrong)):
        movement.land_extract(extract, path, extract_no)
    return movement.read_movement(t.spark, path)


@query("newest_movements", "K4 P6 P9", SEARCH_SQL)
def _(t):
    path = fresh_path(t.spark, "movement")
    movement.land_movement(t.movement, path)
    return newest_movements(
        movement.read_movement(t.spark, path), 5000, start="1999-01-01", end="2001-12-31", plants=["PLANT_1", "PLANT_2"],
        move_types=["OUTBOUND", "RTP", "RETURN"], batch="0_")


RANGES = [(f"{y}-{m:02d}", f"{y}-{m:02d}-01", f"{y}-{m + 2:02d}-28") for y in (1997, 1999, 2000) for m in (1, 4, 6, 9)]
RANGES += [(f"from {y}", f"{y}-03-15", "2001-06-30") for y in range(1995, 2002)] + [("all", "1990-01-01", "2010-12-31")]


def _bitmaps(t):
    """The table of daily bitmaps, written; counting reads nothing else."""
    numbers, bitmaps = fresh_path(t.spark, "invoice-numbers"), fresh_path(t.spark, "invoice-bitmaps")
    invoices.number_invoices(t.movement).write.parquet(numbers)
    return invoices.write_bitmaps(invoices.invoice_bitmaps(t.movement, t.spark.read.parquet(numbers)), bitmaps)


@query("quarterly_invoices_exact", "A1 A2", sql_with(["movement"], """
SELECT plant_code, strftime(date_trunc('quarter', move_date), '%Y-%m') AS quarter, COUNT(DISTINCT ref_no) AS invoice_count
FROM movement WHERE move_type IN ('PURCHASE', 'OUTBOUND') AND ref_no IS NOT NULL GROUP BY ALL"""))
def _(t):
    rows = _bitmaps(t).where(F.col("move_type").isin(PURCHASE, OUTBOUND))
    return invoices.count_invoices(rows, "plant_code", F.date_format(F.date_trunc("quarter", "move_date"), "yyyy-MM").alias("quarter"))


@query("invoices_in_ranges", "A1 A2", sql_with(["movement"], " UNION ALL ".join(
    f"SELECT '{n}' AS range_name, COUNT(DISTINCT ref_no) AS invoice_count FROM movement WHERE move_date BETWEEN DATE '{a}' AND DATE '{b}'"
    for n, a, b in RANGES)))
def _(t):
    return invoices.count_invoices_in_ranges(_bitmaps(t), RANGES)
