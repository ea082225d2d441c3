"""Barcode classification against worked examples, and GS1 fields."""

import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from depotflow.operators import returns, scans

SAME = object()
VECTORS = [
    (None, "EMPTY", ""),
    ("   ", "EMPTY", ""),
    ("　\t", "EMPTY", ""),
    ("0012345678", "OBD", SAME),
    ("812345678", "OBD", SAME),
    ("112345678", "OBD", SAME),
    ("51234567", "OBD", SAME),
    ("8801234567890", "GENERAL_SPECIAL", SAME),
    ("0108801234567890", "GENERAL_SPECIAL", SAME),
    ("010880123456789021SER1", "GENERAL", SAME),
    ("(01)08801234567890(21)SER1", "GENERAL", "010880123456789021SER1"),
    ("3400930000000", "GENERAL", SAME),
    ("688123", "GENERAL", SAME),
    ("010880123456789021SER1]d21724123110LOT", "GENERAL", SAME),
    ("00123456789012345678", "BUNDLE", SAME),
    ("011880123456789021SER1<GS>17241231", "BUNDLE", "(01)18801234567890(21)SER1"),
    ("011880123456789010LOT1<GS>21SER1", "BUNDLE", "(01)18801234567890(21)SER1"),
    ("011880123456789010LOT1<GS>1724123121SER1", "BUNDLE", "(01)18801234567890(21)SER1"),
    ("01188012345678901724123121SER1<GS>10LOT1", "BUNDLE", "(01)18801234567890(31)21SER1<GS>10"),
    ("01188012345678901724123121S1<GS>", "PARSE_ERROR", SAME),
    ("0108806469024613SERIAL", "GENERAL", "010880646902461321SERIAL"),
    ("01088065200095211124101021SER9", "GENERAL", "010880652000952121SER9"),
    ("HELLO", "UNKNOWN", SAME),
    ("]d20108801234567890", "UNKNOWN", SAME),
    ("01088]d2123", "UNKNOWN", SAME),
    ("0108806469024613", "GENERAL", "010880646902461321"),
    ("()", "UNKNOWN", ""),
    # the first delimiter in list order counts, not the leftmost one
    ("011880123456789021AB<GS>X]d2Y", "BUNDLE", "(01)18801234567890(21)AB<GS>X"),
    # a composite bundle with another field keeps its text
    ("011880123456789037LOT1<GS>21SER1", "BUNDLE", SAME),
    # a delimiter too early for a composite
    ("0118801234567<GS>", "UNKNOWN", SAME),
    ("011880123456789010LOT1<GS>1", "PARSE_ERROR", SAME),
    ("011880123456789010LOT12345<GS>17241", "PARSE_ERROR", SAME),
]


def classified(spark, texts, **codes):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, raw string")
    return [(r["type"], r["value"])
            for r in scans.classify_scans(df, **codes).orderBy("id").collect()]


def test_worked_examples(spark):
    found = classified(spark, [v[0] for v in VECTORS])
    for (raw, kind, value), result in zip(VECTORS, found):
        assert result == (kind, raw if value is SAME else value), raw


def test_own_code_lists(spark):
    text = "0100000000000017XYZ"
    assert classified(spark, [text], missing_mark=["0000000000017"])[0][1] == \
        "010000000000001721XYZ"
    assert classified(spark, [text], missing_mark=[], excess_codes=[])[0][1] == text


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="0123458()]d<>gsGSX ", max_size=40), min_size=20, max_size=60))
def test_every_scan_has_one_type(spark, texts):
    found = classified(spark, texts)
    assert len(found) == len(texts)
    kinds = {"EMPTY", "OBD", "GENERAL_SPECIAL", "GENERAL", "BUNDLE", "PARSE_ERROR", "UNKNOWN"}
    assert {kind for kind, _ in found} <= kinds
    assert all(value is not None for _, value in found)


GS1 = [
    ("010880123456789021SER1<GS>1726123110LOT7", "8801234567890", "LOT7",
     dt.date(2026, 12, 31), "SER1"),
    ("01188012345678901724123121SER1<GS>10LOT1", "8801234567890", "LOT1",
     dt.date(2024, 12, 31), "SER1"),
    ("011880123456789010LOT1]D221SER1", "8801234567890", "LOT1", None, "SER1"),
    ("01188012345678901724020010L", "8801234567890", "L", dt.date(2024, 2, 29), None),
    ("011880123456789017249931", "8801234567890", None, None, None),
    ("8801234567890", "8801234567890", None, None, None),
    ("(01)08801234567890(17)261231(10)A10B21", "8801234567890", "A10B21",
     dt.date(2026, 12, 31), None),
    ("HELLO", None, None, None, None),
    (None, None, None, None, None),
]


@pytest.mark.parametrize("case", GS1, ids=lambda c: str(c[0]))
def test_gs1_fields(spark, case):
    df = spark.createDataFrame([(case[0],)], "raw string")
    row = scans.extract_gs1(df).collect()[0]
    assert (row.gtin, row.batch, row.expiry, row.serial) == case[1:]


GS = "\x1d"
CODE = "0108801234567890"


@pytest.mark.parametrize("raw, batch, day", [
    (f"]d2{CODE}17250131" + "10AB7", "AB7", "2025-01-31"),
    (f"{GS}{CODE}10AB7{GS}17250131", "AB7", "2025-01-31"),
    (f"]C1{CODE}11240131" + "17250131" + "10AB7", "AB7", "2025-01-31"),
    (f"{CODE}240X1{GS}3103000750" + "17250131" + f"21S9{GS}10AB7", "AB7", "2025-01-31"),
    (f"{CODE}11240131", None, None),
])
def test_gs1_other_fields(spark, raw, batch, day):
    df = scans.extract_gs1(spark.createDataFrame([(raw,)], "raw string"))
    row = df.collect()[0]
    assert (row.gtin, row.batch, row.expiry and str(row.expiry)) == ("8801234567890", batch, day)
    assert returns.unmatched_scans(df).count() == (batch is None)
