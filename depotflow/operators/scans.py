"""Barcode scans: repair, classification, GS1 fields and counts.

Everything is a column expression built in named steps, so it runs on batch and
streaming frames alike.
"""

import re

from pyspark.sql import functions as F

from ..functions.once import computed_once
from ..functions.text import is_blank

# Product codes whose labels are printed wrongly, the text that is
# missing or in excess, and the group separators in order of precedence.
MISSING_SERIAL_MARK = ["8806469024613", "8806469024729", "8806469024910"]
SERIAL_MARK = "21"
EXCESS_TEXT_CODES = ["8806520009521"]
EXCESS_TEXT = "11241010"
DELIMITERS = ["]d2", "<gs>", "[gs]"]

# Fixed values: (first character, length) of outbound documents, the prefixes of
# the two plain unit forms, and the longest special form.
OUTBOUND_SHAPES = [("0", 10), ("8", 9), ("1", 9), ("5", 8)]
SPECIAL_PREFIXES = ["01088", "188", "088", "88"]
SPECIAL_MAX_LENGTH = 17
UNIT_PREFIXES = ["01088", "88", "3"]
COMPOSITE_MIN_INDEX = 18

_GS = "\x1d"
# Fields of a set length in the public GS1 table, and those that a separator ends.
_FIXED_FIELDS = (("17", "17[0-9]{6}"), ("", "1[1-68-9][0-9]{6}"), ("", "20[0-9]{2}"),
                 ("", "3[1-6][0-9]{8}"), ("", "41[0-9]{14}"))
_OPEN_FIELDS = ("10", "21", "2[2-9]", "3[0789]", "4[02-9]", "[5-9][0-9]")


def _any(conditions):
    result = F.lit(False)
    for condition in conditions:
        result = result | condition
    return result


def _cut(text, start, length=None):
    """Characters from a 0-based start."""
    text = F.col(text) if isinstance(text, str) else text
    start = F.lit(start) if isinstance(start, int) else start
    length = F.length(text) if length is None else length
    return F.substring(text, start + 1, F.lit(length) if isinstance(length, int) else length)


def _codes(codes):
    """Pattern of texts with one of the product codes in its place, from the start."""
    return f"(?s)^(.{{3}}(?:{'|'.join(map(re.escape, codes))}))" if codes else "$^"


def repair_scans(scans, missing_mark=None, excess_codes=None):
    """Adds `repaired`: no parentheses, and known misprints put right."""
    missing_mark = MISSING_SERIAL_MARK if missing_mark is None else missing_mark
    excess_codes = EXCESS_TEXT_CODES if excess_codes is None else excess_codes
    bare = F.translate(F.coalesce("raw", F.lit("")), "()", "")
    return scans.withColumn("repaired", (
        F.when(F.rlike(bare, F.lit(_codes(excess_codes))),
               F.replace(bare, F.lit(EXCESS_TEXT), F.lit("")))
        .otherwise(F.regexp_replace(bare, _codes(missing_mark), f"$1{SERIAL_MARK}"))))


def _with_delimiter(scans):
    """Position of the first delimiter in list order (0 without one), and the place behind it."""
    lower = scans.withColumn("lower", F.lower("repaired"))
    at, length = F.lit(0), F.lit(0)
    for delimiter in reversed(DELIMITERS):
        position = F.instr(F.col("lower"), delimiter)
        at = F.when(position > 0, position - 1).otherwise(at)
        length = F.when(position > 0, len(delimiter)).otherwise(length)
    return lower.withColumn("at", at).withColumn("after", F.col("at") + length).drop("lower")


def _with_bundle_value(scans):
    """Value of a composite bundle, NULL where a piece would run past the end."""
    text, at, after = F.col("repaired"), F.col("at"), F.col("after")
    length = F.length(text)
    head = F.concat(F.lit("("), _cut(text, 0, 2), F.lit(")"), _cut(text, 2, 14))

    def marked(mark, value):
        return F.concat(head, F.lit("("), mark, F.lit(")"), value)

    def need(bound, value):
        return F.when(length >= bound, value)

    ai = _cut(text, 16, 2)
    behind = _cut(text, after, 2)
    after_expiry = need(after + 10, marked(_cut(text, after + 8, 2), _cut(text, after + 10)))
    by_delimiter = need(after + 2, (
        F.when(behind == "21", marked(behind, _cut(text, after + 2)))
        .when(behind == "17", after_expiry)
        .otherwise(text)))
    dated = need(26, (
        F.when(_cut(text, 24, 2) == "21",
               need(at + 6, marked(_cut(text, 22, 2), _cut(text, 24, at - 18))))
        .otherwise(by_delimiter)))
    return scans.withColumn("bundle", (
        F.when(ai == "21", marked(ai, _cut(text, 18, at - 18)))
        .when(ai.isin("17", "10"), dated)
        .otherwise(text)))


def classify_scans(scans, missing_mark=None, excess_codes=None):
    """Type of each scan and the value to send.

    Types: EMPTY, OBD (outbound document), GENERAL_SPECIAL and GENERAL (units),
    BUNDLE, UNKNOWN, and PARSE_ERROR where a composite bundle ends too early.
    """
    steps = _with_bundle_value(_with_delimiter(repair_scans(scans, missing_mark, excess_codes)))
    text, at = F.col("repaired"), F.col("at")
    length = F.length(text)
    plain, composite = at == 0, at >= COMPOSITE_MIN_INDEX
    first, second, third = (_cut(text, i, 1) for i in range(3))

    document = _any(text.startswith(c) & (length == n) for c, n in OUTBOUND_SHAPES)
    special = plain & (length <= SPECIAL_MAX_LENGTH) & _any(
        text.startswith(p) for p in SPECIAL_PREFIXES)
    # The check of the first character lets every printable one through.
    third_form = (length >= 3) & (F.ascii(first) >= 9) & (second == "8") & (third == "8")
    unit = plain & (_any(text.startswith(p) for p in UNIT_PREFIXES) | third_form)
    composite_unit = text.startswith("010") & composite
    packed = text.startswith("00") & third.between("0", "9") | (
        text.startswith("01") & third.between("1", "9"))
    bundle_type = F.when(F.col("bundle").isNull(), "PARSE_ERROR").otherwise("BUNDLE")

    kind = (
        F.when(is_blank(F.col("raw")), "EMPTY")
        .when(document, "OBD")
        .when(special, "GENERAL_SPECIAL")
        .when(unit | composite_unit, "GENERAL")
        .when(packed & plain, "BUNDLE")
        .when(packed & composite, bundle_type)
        .otherwise("UNKNOWN"))
    value = (
        F.when(F.col("type") == "EMPTY", "")
        .when((F.col("type") == "BUNDLE") & composite, F.col("bundle"))
        .otherwise(text))
    return steps.withColumn("type", kind).withColumn("value", value).select(
        *scans.columns, "type", "value")


def separated_text(scans, missing_mark=None, excess_codes=None):
    """Adds `text`: the repaired text with one sign for all separators, without those and a symbology prefix in front."""
    return repair_scans(scans, missing_mark, excess_codes).withColumn(
        "text", F.regexp_replace("repaired", r"(?i)\]d2|<gs>|\[gs\]", _GS)).withColumn(
        "text", F.regexp_replace("text", rf"^(?:{_GS}|\][A-Za-z][0-9])+", ""))


def extract_gs1(scans, missing_mark=None, excess_codes=None):
    """Product code, batch, expiry and serial of each scan, NULL where absent.

    Reads the repaired text as a sequence of fields: 01 with 14 digits (the
    first is the packing level), 17 with 6 digits, and 10 and 21 which run to
    the next separator or the end. Other fields in front of a wanted one are passed
    over, by their fixed length or up to the next separator. Separators and a symbology
    prefix in front of the text are ignored. A bare 13-digit code counts as a product code.
    """
    start = "^01[0-9]{14}"
    product = "(?:^01[0-9]|^(?=[0-9]{13}$))([0-9]{13})"

    def behind_others(ai, value):
        fixed = "|".join(f for a, f in _FIXED_FIELDS if a != ai)
        open_ = "|".join(a for a in _OPEN_FIELDS if a != ai)
        return f"{start}(?:(?:{fixed}){_GS}?|(?:{open_})[^{_GS}]*{_GS})*{ai}({value})"

    batch = behind_others("10", f"[^{_GS}]+")
    serial = behind_others("21", f"[^{_GS}]+")
    expiry = behind_others("17", "[0-9]{6}")

    def found(pattern):
        return F.nullif(F.regexp_extract("text", pattern, 1), F.lit(""))

    yymmdd = F.col("yymmdd")
    month = F.concat(F.lit("20"), _cut(yymmdd, 0, 2), F.lit("-"), _cut(yymmdd, 2, 2), F.lit("-"))
    # Day 00 stands for the last day of the month.
    day = _cut(yymmdd, 4, 2)
    date = F.when(day == "00", F.last_day(F.concat(month, F.lit("01")).try_cast("date"))).otherwise(
        F.concat(month, day).try_cast("date"))
    fields = computed_once(separated_text(scans, missing_mark, excess_codes), {
        "gtin": found(product), "batch": found(batch), "yymmdd": found(expiry),
        "serial": found(serial)})
    return fields.withColumn("expiry", date).select(
        *scans.columns, "gtin", "batch", "expiry", "serial")


def count_scans(scans):
    """Number of scans per product code, batch and expiry."""
    return (
        extract_gs1(scans).where(F.col("gtin").isNotNull())
        .groupBy("gtin", "batch", "expiry").agg(F.count("*").alias("scanned_qty")))


def scan_type_profile(scans):
    """Number of scans per type."""
    return classify_scans(scans).groupBy("type").agg(F.count("*").alias("scan_count"))
