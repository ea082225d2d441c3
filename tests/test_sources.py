"""Sources, sinks and streams."""

import datetime as dt

import pytest
from pyspark.errors import AnalysisException
from test_movement import move

from depotflow.operators.filters import date_range_filter
from depotflow.operators.returns import (
    completed_returns, match_returns, open_returns)
from depotflow.operators.scans import extract_gs1
from depotflow.operators.stock import clean_stock, dedupe_stock, stock_by_product, stock_sheet
from depotflow.schema import MOVEMENT, ORDER_HEADERS
from depotflow.session import fresh_path, shared_dir
from depotflow.sources import movement, sinks, tables
from depotflow.streaming import scans as streams

SCANS = [
    "011880000000000110LOT7<GS>21A", "011880000000000110LOT7<GS>21B",
    "011880000000000210LOT7<GS>21C", "011880000000000910LOT7<GS>21D", "HELLO", "8800000000001",
]
RETURN_LIST = [("8800000000001", "LOT7", 2), ("8800000000002", "LOT7", 2), ("8800000000003", "LOT7", 1)]


@pytest.fixture
def landed(spark):
    days = [dt.date(2024, month, 5) for month in (1, 2, 3)]
    m = spark.createDataFrame([move(move_date=d, partner_name=p) for d in days for p in "ab"], MOVEMENT)
    path = fresh_path(spark, "landed")
    movement.land_movement(m, path)
    return path


def test_shared_dir_is_the_configured_one(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_missing_table_raises(spark):
    with pytest.raises(AnalysisException):
        movement.read_movement(spark, "/nowhere/movement")


def test_date_filter_reads_one_month_of_a_landed_table(spark, landed):
    m = date_range_filter(movement.read_movement(spark, landed), "2024-02-01", "2024-02-29")
    assert m.count() == 2
    scan = m._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(move_month" in scan
    assert "PushedFilters: [IsNotNull(move_date)" in scan


def test_landing_twice_is_refused(spark, landed):
    with pytest.raises(AnalysisException):
        movement.land_movement(movement.read_movement(spark, landed).drop("move_month"), landed)


def test_labels_and_headers_are_translated(spark):
    raw = spark.createDataFrame([("일반 출하", 1), ("RTP", 2), ("other", 3)], ["Move_Desc", "Qty"])
    found = movement.standardise_movement(raw)
    assert [tuple(r) for r in found.collect()] == [("OUTBOUND", 1), ("RTP", 2), ("other", 3)]
    assert found.columns == ["move_type", "qty"]


def test_order_headers(spark):
    df = spark.createDataFrame([("a", "b", 1)], ["거래처명", "주소", "extra"])
    assert tables.normalise_headers(df, ORDER_HEADERS).columns == ["name", "address", "extra"]


def test_name_column_is_the_first_in_file_order(spark):
    df = spark.createDataFrame([(0, "x", "y")], ["row_no", "고객명", "name"])
    assert tables.detect_name_column(df).first().customer_name == "x"
    assert tables.detect_name_column(df.select("row_no")).first().customer_name == "order_1"


def test_split_makes_one_folder_per_value_and_keeps_rows(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b/c"), (4, None)], "id int, who string")
    path = str(tmp_path / "out")
    sinks.split_by_column(df, "who", path, max_records=1)
    assert len([p for p in (tmp_path / "out").iterdir() if p.is_dir()]) == 3
    back = spark.read.parquet(path).select("id", "who")
    assert sorted(map(tuple, back.collect())) == [(1, "a"), (2, "a"), (3, "b/c"), (4, None)]
    with pytest.raises(AnalysisException):
        sinks.split_by_column(df, "who", path)


def test_csv_has_a_header_and_is_not_replaced(spark, tmp_path):
    path = str(tmp_path / "csv")
    sinks.write_csv(spark.range(3).coalesce(1), path)
    assert next((tmp_path / "csv").glob("*.csv")).read_text().splitlines() == ["id", "0", "1", "2"]
    with pytest.raises(AnalysisException):
        sinks.write_csv(spark.range(3), path)


@pytest.fixture
def scan_files(spark):
    path = fresh_path(spark, "scans")
    for part in (SCANS[:2], SCANS[2:]):
        spark.createDataFrame([(t,) for t in part], "raw string").coalesce(1).write.mode(
            "append").parquet(path)
    return path


def test_returns_partition_the_list(spark):
    scans = extract_gs1(spark.createDataFrame([(t,) for t in SCANS], "raw string"))
    lines = spark.createDataFrame(RETURN_LIST, "gtin string, batch string, expected_qty long")
    stock = spark.createDataFrame([("8800000000001", "LOT7", 4), ("8800000000001", "LOT7", 1)],
                                  "gtin string, batch string, qty long")
    matched = match_returns(scans, lines, stock)
    found = {r.gtin[-1]: (r.expected_qty, r.scanned_qty, r.stock_qty, r.status)
             for r in matched.collect()}
    assert found == {"1": (2, 2, 5, "COMPLETE"), "2": (2, 1, None, "OPEN"),
                     "3": (1, 0, None, "OPEN"), "9": (None, 1, None, "NOT_LISTED")}
    done = completed_returns(matched)
    still = open_returns(lines, done)
    assert sorted(r.gtin for r in done.select("gtin").union(still.select("gtin")).collect()) == \
        sorted(line[0] for line in RETURN_LIST)


def test_streams_equal_the_batch_results(spark, scan_files):
    stream = spark.readStream.schema("raw string").option("maxFilesPerTrigger", 1).parquet(scan_files)
    out = fresh_path(spark, "classified")
    streams.classify_stream(stream, out, fresh_path(spark, "checkpoint")).awaitTermination()
    assert spark.read.parquet(out).count() == len(SCANS)

    lines = spark.createDataFrame(RETURN_LIST, "gtin string, batch string, expected_qty long")
    path = fresh_path(spark, "matches")
    streams.match_returns_stream(
        stream, lines, path, fresh_path(spark, "checkpoint")).awaitTermination()
    last = streams.latest_matches(spark, path)
    assert {r.gtin[-1]: (r.scanned_qty, r.status) for r in last.collect()} == {
        "1": (2, "COMPLETE"), "2": (1, "OPEN"), "9": (1, "NOT_LISTED")}
    stock = spark.createDataFrame([], "gtin string, batch string, qty long")
    batch = match_returns(extract_gs1(spark.read.parquet(scan_files)), lines, stock)
    both = streams.match_with_stock(last, lines, stock)
    assert sorted(map(str, both.collect())) == sorted(map(str, batch.collect()))


def test_stock_sheets(spark):
    stock = spark.createDataFrame(
        [("P", "L2", "1", "x", "b1", 5), ("P", "L2", "1", "x", "b2", 7), ("P", "L1", "2", None, "b", 1),
         ("P", "L1", "2", None, "b", 1), ("P", "GI-ZONE", "1", "x", "b", 9), ("P", None, "3", "z", "b", 2)],
        "plant_code string, storage_loc string, product_code string, product_name string, "
        "batch string, qty long")
    assert clean_stock(stock).count() == 5
    assert dedupe_stock(stock).count() == 5
    assert {r.product_code: r.qty for r in stock_by_product(stock).collect()} == {"1": 21, "2": 2, "3": 2}
    assert [tuple(r) for r in stock_sheet(stock, "daily").collect()] == [
        ("L1", "2", None, 1), ("L2", "1", "x", 12), (None, "3", "z", 2)]
    assert [tuple(r) for r in stock_sheet(stock, "upload").collect()] == [
        ("2", "L1", 1), ("1", "L2", 12), ("3", None, 2)]
    full = stock_sheet(stock, "full")
    assert full.columns[-3:] == ["counted_by", "keyed_by", "approved_by"] and full.count() == 4
    with pytest.raises(ValueError):
        stock_sheet(stock, "other")


def test_extract_with_its_own_headers(spark, tmp_path):
    from depotflow.schema import MOVE_TYPE_LABELS, MOVEMENT, MOVEMENT_HEADERS
    label, code = next(iter(MOVE_TYPE_LABELS.items()))
    value = {"move_date": "2001-06-15 08:30:00", "move_type": label, "qty": "3", "amount": "40",
             "partner_name": '"A ""b"",\nC"'}
    headers = list(MOVEMENT_HEADERS)[::-1]
    row = ",".join(value.get(MOVEMENT_HEADERS[h], "") for h in headers)
    (tmp_path / "extract.csv").write_text(",".join(headers) + "\n" + row + "\n", encoding="utf-8")
    found = movement.read_extract(spark, str(tmp_path / "extract.csv"))
    assert found.schema.fieldNames() == MOVEMENT.fieldNames()
    row = found.first()
    assert (str(row.move_date), row.move_type, row.qty, row.amount, row.partner_name, row.batch) == (
        "2001-06-15", code, 3, 40, 'A "b",\nC', None)
    movement.land_movement(found, str(tmp_path / "landed"))
    assert movement.read_movement(spark, str(tmp_path / "landed")).first().move_month == "2001-06"
