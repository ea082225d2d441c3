"""Landing again, newest rows, invoice bitmaps and stream sessions on small tables."""

import datetime as dt
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from depotflow.operators import invoices
from depotflow.operators.filters import newest_movements, search_movements
from depotflow.plans.fixtures import fixture
from depotflow.schema import MOVEMENT, SCAN
from depotflow.session import fresh_path
from depotflow.sources import movement as source
from depotflow.sources.movement import land_extract, land_movement, read_movement
from depotflow.streaming import sessions


def movement(spark, rows):
    """Rows (ref, day, time, plant, type, amount); a day may be None."""
    full = [(d and dt.date.fromisoformat(d), t, plant, kind, "L", "P", "A", "C", "N", "B1", 1, amount, ref) for ref, d, t, plant, kind, amount in rows]
    return spark.createDataFrame(full, MOVEMENT)


def plain(spark, path):
    return sorted(((r.ref_no, str(r.move_date), r.amount, r.move_month) for r in read_movement(spark, path).collect()), key=str)


def files(path):
    return {str(f): f.stat().st_mtime_ns for f in Path(path).rglob("*.parquet")}


def test_landing_a_correction(spark):
    path = fresh_path(spark, "extracts")
    one = movement(spark, [("I1", "2020-01-05", None, "P", "S", 1), ("I1", "2020-01-06", None, "P", "S", 2), ("I2", "2020-02-01", None, "P", "S", 3),
                           ("I3", "2020-03-01", None, "P", "S", 4), (None, "2020-03-02", None, "P", "S", 5), ("I9", None, None, "P", "S", 9)])
    assert land_extract(one, path, 1) == [None, "2020-01", "2020-02", "2020-03"]
    before = files(path)
    # I2 moves to another month and leaves its old one empty; I1 loses a row; I4 is new
    two = movement(spark, [("I1", "2020-01-05", None, "P", "S", 10), ("I2", "2020-04-01", None, "P", "S", 30), ("I4", "2020-01-09", None, "P", "S", 40)])
    want = sorted([("I1", "2020-01-05", 10, "2020-01"), ("I2", "2020-04-01", 30, "2020-04"), ("I4", "2020-01-09", 40, "2020-01"),
                   ("I3", "2020-03-01", 4, "2020-03"), (None, "2020-03-02", 5, "2020-03"), ("I9", "None", 9, None)], key=str)
    for _ in range(2):
        assert land_extract(two, path, 2) == ["2020-01", "2020-02", "2020-04"] or _ == 1
        assert plain(spark, path) == want
    kept = {f for f in before if "move_month=2020-03" in f or "HIVE_DEFAULT" in f}
    assert len(kept) == 2 and all(files(path).get(f) == before[f] for f in kept)
    assert not Path(path, "move_month=2020-02").exists()
    late = movement(spark, [("I1", "2020-01-01", None, "P", "S", 7), ("I5", "2020-03-05", None, "P", "S", 8)])
    land_extract(late, path, 0)
    assert plain(spark, path) == sorted([*want, ("I5", "2020-03-05", 8, "2020-03")], key=str)
    assert land_extract(late.limit(0), path, 7) == []


def test_landing_rewrites_only_months_that_change(spark):
    path = fresh_path(spark, "extracts")
    one = movement(spark, [(f"I{i}", f"2020-0{1 + i % 3}-05", None, "P", "S", i) for i in range(9)] + [(None, None, "08:00:00", "P", "S", 1)])
    two = movement(spark, [("I1", "2020-02-05", None, "P", "S", 10), ("I3", "2020-01-05", None, "P", "S", 3)])
    land_extract(one, path, 1)
    assert land_extract(two, path, 2) == ["2020-01", "2020-02"]
    before, rows = files(path), plain(spark, path)
    # both again, the older one last: nothing to write
    assert land_extract(two, path, 2) == [] and land_extract(one, path, 1) == []
    assert files(path) == before and plain(spark, path) == rows
    # the same number with other rows replaces its own: an amount, a row that comes twice, a value in another column
    for changed in ([("I1", "2020-02-05", None, "P", "S", 11), ("I3", "2020-01-05", None, "P", "S", 3)],
                    [("I1", "2020-02-05", None, "P", "S", 11)] * 2 + [("I3", "2020-01-05", None, "P", "S", 3)],
                    [("I1", "2020-02-05", "P", None, "S", 11)] * 2 + [("I3", "2020-01-05", None, "P", "S", 3)]):
        assert land_extract(movement(spark, changed), path, 2) == ["2020-02"]
        kept = [r for r in rows if r[0] != "I1"]
        assert plain(spark, path) == sorted(kept + [("I1", "2020-02-05", 11, "2020-02")] * (len(changed) - 1), key=str)
        assert land_extract(movement(spark, changed), path, 2) == []
    assert [p.name for p in Path(path).parent.glob(f"{Path(path).name}.landing-*")] == []


@pytest.mark.parametrize("most", [source.MOST_BITMAPS, 0])
def test_rows_that_stay_are_not_shuffled_by_key(spark, monkeypatch, most):
    """Replaced rows are known by their places; the others only move to the task that writes their month."""
    path, months = fresh_path(spark, "extracts"), [None, *[f"2020-{m:02d}" for m in range(1, 13)]]
    one = [(f"I{i % 9000}" if i % 50 else None, months[i % 13] and f"{months[i % 13]}-0{1 + i % 7}", None, "P", "S", i) for i in range(20_000)]
    two = [(f"I{i}", "2020-05-09", None, "P", "S", -i) for i in range(0, 9000, 4)]
    monkeypatch.setattr(source, "FILE_ROWS", 700)
    monkeypatch.setattr(source, "PACKED_BYTES", 40_000)
    monkeypatch.setattr(source, "MOST_BITMAPS", most, raising=False)
    land_extract(movement(spark, one).repartition(3), path, 1)
    plans, put = [], source._put_months

    def noted(rows, *args, **kwargs):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return put(rows, *args, **kwargs)

    monkeypatch.setattr(source, "_put_months", noted)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert land_extract(movement(spark, two), path, 2) == months
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    taken = {r[0] for r in two}
    want = [(r[0], str(r[1]), r[5], r[1] and r[1][:7]) for r in one if r[0] not in taken] + [(r[0], r[1], r[5], "2020-05") for r in two]
    assert plain(spark, path) == sorted(want, key=str)
    assert "hashpartitioning(ref_no" not in plans[0]
    assert bool(most) != ("hashpartitioning" in plans[0])
    # about 1,150 rows a month, 3,400 in one, and three more of nulls: a file for each 700, and few that share
    assert all(len(list(p.glob("*.parquet"))) <= 7 for p in Path(path).glob("move_month=*"))


def test_joins_of_large_tables_give_the_same_rows(spark):
    folder = "/root/testdata/sf0.001"
    one, two = (fixture(spark, folder, "movement", large=large) for large in (False, True))
    assert one.schema == two.schema and one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty() and not two.isEmpty()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = fixture(spark, folder, "movement", large=True)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    lines = plan.split("\n")
    at = next(i for i, line in enumerate(lines) if "l_linenumber" in line and "FileScan" in line)
    deep = len(lines[at]) - len(lines[at].lstrip(" :|+-"))
    over = [line for i, line in enumerate(lines[:at]) if "Exchange" in line and len(line) - len(line.lstrip(" :|+-")) < deep
            and all(len(x) - len(x.lstrip(" :|+-")) > len(line) - len(line.lstrip(" :|+-")) for x in lines[i + 1:at + 1])]
    assert len(over) == 2  # a line item moves to its part and to its order


@pytest.fixture(scope="module")
def landed(spark):
    rng = random.Random(4)
    rows = [(f"R{i}", None if rng.random() < 0.05 else f"20{rng.randint(18, 21)}-{rng.randint(1, 12):02d}-{rng.randint(1, 3):02d}",
             None if rng.random() < 0.2 else f"1{rng.randint(0, 2)}:00:00", f"P{rng.randint(0, 2)}", "S", i) for i in range(1500)]
    path = fresh_path(spark, "movement")
    land_movement(movement(spark, rows), path)
    return read_movement(spark, path)


@pytest.mark.parametrize("n", [1, 7, 100, 1400, 5000])
def test_newest_rows(landed, n):
    found = newest_movements(landed, n, plants=["P0", "P1"])
    want = search_movements(landed, plants=["P0", "P1"], limit=n)
    assert found.collect() == want.collect()


def test_newest_rows_read_their_months(landed, capsys):
    newest_movements(landed, 5).explain("formatted")
    scans = [line for line in capsys.readouterr().out.splitlines() if "PartitionFilters" in line]
    assert any("ubquery" in line and "move_month" in line for line in scans)
    with pytest.raises(ValueError):
        newest_movements(landed, 0)


def test_invoices_of_any_range(spark):
    rng = random.Random(1)
    rows = [(None if rng.random() < 0.02 else f"R{rng.randint(0, 40000)}", None if rng.random() < 0.02 else str(
        dt.date(2020, 1, 1) + dt.timedelta(days=rng.randint(0, 700))), None, f"P{rng.randint(0, 2)}", rng.choice(["S", "T"]), 1) for _ in range(30000)]
    m = movement(spark, rows)
    numbers, table = fresh_path(spark, "numbers"), fresh_path(spark, "bitmaps")
    invoices.number_invoices(m).write.parquet(numbers)
    invoices.invoice_bitmaps(m, spark.read.parquet(numbers)).write.parquet(table)
    bitmaps = spark.read.parquet(table)
    ranges = []
    for i in range(20):
        a = dt.date(2020, 1, 1) + dt.timedelta(days=rng.randint(-50, 700))
        ranges.append((f"r{i}", str(a), str(a + dt.timedelta(days=rng.randint(0, 400)))))
    found = {r.range_name: r.invoice_count for r in invoices.count_invoices_in_ranges(bitmaps, ranges).collect()}
    assert found == {n: len({r for r, d, *_ in rows if r and d and a <= d <= b}) for n, a, b in ranges}
    by_plant = {r.plant_code: r.invoice_count for r in invoices.count_invoices(bitmaps.where("move_type = 'S'"), "plant_code").collect()}
    assert by_plant == {p: len({r for r, _, _, q, k, _ in rows if r and q == p and k == "S"}) for p in ("P0", "P1", "P2")}
    assert bitmaps.where("length(bits) > 4096").isEmpty()


def test_sessions_end_and_leave_the_state(spark):
    start = dt.datetime(2024, 5, 1, 8)
    def scan(day, n, product):
        return (1, n, day % 2, start + dt.timedelta(days=day, minutes=n % 300), f"01880{product:010d}88".replace("01880", "010880")[:16] + "10LOT7")
    path, parts = fresh_path(spark, "scans"), [[0, 1], [2, 3], [4, 5], [6, 7], [8, 9, 1]]
    for days in parts:      # the last part brings scans of a day that ended long before
        rows = [scan(d, n, n % 40) for d in days for n in range(120)]
        spark.createDataFrame(rows, SCAN).coalesce(1).write.mode("append").parquet(path)
    out = fresh_path(spark, "sessions")
    stream = spark.readStream.schema(SCAN).option("maxFilesPerTrigger", 1).parquet(path)
    run = sessions.close_sessions_stream(stream, out, fresh_path(spark, "checkpoint"), delay="12 hours")
    run.awaitTermination()
    states = [p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress if p["stateOperators"]]
    assert len(states) >= 5 and max(states) <= 40 * 4 and states[-1] < max(states)
    raw, closed = spark.read.schema(SCAN).parquet(path), spark.read.parquet(out)
    every = sessions.return_sessions(raw)
    ended = every.agg(F.sum("scanned_qty").alias("n")).first()["n"]
    late = sessions.late_scans(raw, closed)
    last = closed.agg(F.max("session_end")).first()[0]
    still_open = every.where(F.col("session_end") > last).agg(F.sum("scanned_qty")).first()[0]
    assert late.agg(F.sum("late_qty")).first()[0] == 120 and {r.session_start.day for r in late.collect()} == {2}
    assert closed.agg(F.sum("scanned_qty")).first()[0] + 120 + still_open == ended
    assert closed.count() == closed.select(*sessions.SESSION).distinct().count()
    lists = spark.createDataFrame([], "gtin string, batch string, expected_qty long"), spark.createDataFrame([], "gtin string, batch string, qty long")
    assert {r.status for r in sessions.match_closed_sessions(closed, *lists).collect()} == {"NOT_LISTED"}


def test_bitmaps_are_made_behind_the_shuffle(spark):
    m = spark.createDataFrame([(dt.date(2000, 1, 1), "P", "S", "a")], "move_date date, plant_code string, move_type string, ref_no string")
    numbers = spark.createDataFrame([("a", 1)], "ref_no string, invoice_id long")
    text = invoices.invoice_bitmaps(m, numbers)._jdf.queryExecution().executedPlan().toString()
    assert 0 < text.index("partial_bitmap_construct_agg") < text.index("Exchange")
