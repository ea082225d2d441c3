"""Fields of element strings: labelled codes, separators, faults."""

import pytest

from depotflow.operators.gs1 import gs1_fields
from depotflow.schema import SCAN

G = "\x1d"
CODE = "01" + "18801234567890"
CASES = [
    (CODE, {"01": "18801234567890"}, None),
    (CODE + "21SER" + "<GS>" + "1726123110LOT7", {"01": "18801234567890", "21": "SER", "17": "261231", "10": "LOT7"}, None),
    (CODE + "17261231" + "10LOT[gs]21S1", {"01": "18801234567890", "17": "261231", "10": "LOT", "21": "S1"}, None),
    (CODE + "]d210A", {"01": "18801234567890", "10": "A"}, None),
    ("]C1" + CODE + "3103001500" + "10B", {"01": "18801234567890", "3103": "001500", "10": "B"}, None),
    ("00123456789012345678", {"00": "123456789012345678"}, None),
    ("(01)18801234567890(240)XY<GS>(91)free text", {"01": "18801234567890", "240": "XY", "91": "free text"}, None),
    ("4101234567890123" + "37" + "12", {"410": "1234567890123", "37": "12"}, None),
    (CODE + "7003" + "2612311200" + "<gs>" + "8005123456", {"01": "18801234567890", "7003": "2612311200", "8005": "123456"}, None),
    (CODE + "10A<GS>10B", {"01": "18801234567890", "10": "A"}, None),
    (CODE + "17261231" * 2, {"01": "18801234567890", "17": "261231"}, None),
    ("<GS><GS>" + CODE + "<GS>", {"01": "18801234567890"}, None),
    (CODE + "20" + "01" + "20", {"01": "18801234567890", "20": "01"}, "TOO_SHORT:20"),
    (CODE + "1726", {"01": "18801234567890"}, "TOO_SHORT:17"),
    (CODE + "17ABCDEF", {"01": "18801234567890"}, "NOT_DIGITS:17"),
    (CODE + "10<GS>21S", {"01": "18801234567890"}, "EMPTY:10"),
    (CODE + "50X", {"01": "18801234567890"}, "UNKNOWN_IDENTIFIER:50"),
    (CODE + "31", {"01": "18801234567890"}, "UNKNOWN_IDENTIFIER:31"),
    (CODE + "2x", {"01": "18801234567890"}, "UNKNOWN_IDENTIFIER:2x"),
    ("X12345", {}, "UNKNOWN_IDENTIFIER:X1"), ("1", {}, "UNKNOWN_IDENTIFIER:1"),
    ("", {}, "NO_TEXT"), (None, {}, "NO_TEXT"), ("<GS>", {}, "NO_TEXT"), ("   ", {}, "NO_TEXT"),
    (CODE + "10" + "L" * 5000, {"01": "18801234567890", "10": "L" * 5000}, None),
    (CODE + "1726123\n", {"01": "18801234567890"}, "NOT_DIGITS:17"), (CODE + "23\nA", {"01": "18801234567890"}, "UNKNOWN_IDENTIFIER:23"),
    (CODE + "10A\nB<GS>21\u00e9\U0001f600", {"01": "18801234567890", "10": "A\nB", "21": "\u00e9\U0001f600"}, None),
    ("10" + "<GS>10".join(str(i) for i in range(5000)) + "<GS>21S", {"10": "0", "21": "S"}, None),
]


@pytest.fixture(scope="module")
def read(spark):
    rows = [(i, 1, 1, None, raw) for i, (raw, _, _) in enumerate(CASES)]
    return {r.scan_group: (r.fields, r.reason) for r in gs1_fields(spark.createDataFrame(rows, SCAN)).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_labelled_codes(read, i):
    assert read[i] == CASES[i][1:]


def test_a_text_is_read_without_a_step_for_every_field(spark):
    """The number of lambdas in the plan, each run for every element, is that of fields made and compared."""
    found = gs1_fields(spark.createDataFrame([(1, 1, 1, None, CODE)], SCAN))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan and plan.count("lambdafunction(") <= 2
