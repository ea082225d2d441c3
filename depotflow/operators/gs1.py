"""All fields of a GS1 element string, read by a pattern made from a table of identifiers."""

from pyspark.sql import functions as F

from ..functions.once import computed_once
from .scans import separated_text

# Fixed values of the public GS1 table: first two digits of an identifier, digits of the
# whole identifier, and digits of its data where that length is set (0: runs to a separator or the end).
IDENTIFIERS = (
    ("00", 2, 18), ("01", 2, 14), ("02", 2, 14), ("03", 2, 14), ("04", 2, 16), ("10", 2, 0),
    *((str(n), 2, 6) for n in range(11, 20)), ("20", 2, 2), ("21", 2, 0), ("22", 2, 0), ("23", 3, 0),
    ("24", 3, 0), ("25", 3, 0), ("30", 2, 0), *((str(n), 4, 6) for n in range(31, 37)), ("37", 2, 0),
    ("39", 4, 0), ("40", 3, 0), ("41", 3, 13), ("42", 3, 0), ("43", 4, 0), ("70", 4, 0), ("71", 3, 0),
    ("72", 4, 0), ("80", 4, 0), ("81", 4, 0), ("82", 4, 0), *((str(n), 2, 0) for n in range(90, 100)))

_GS = "\x1d"


def _rules():
    return F.create_map(*[x for two, digits, size in IDENTIFIERS for x in (
        F.lit(two), F.struct(F.lit(digits).alias("digits"), F.lit(size).alias("size")))])


def _field_pattern():
    """Pattern of the next readable field with the separators in front of it; group 1 is its identifier.

    A match starts where the one before has ended, so the first field that cannot be read ends the matches. The first two
    digits tell the identifier, so at most one alternative fits, and each has one way to match.
    """
    shapes, lengths = {}, {}
    for two, digits, size in IDENTIFIERS:
        shapes.setdefault((digits, size), []).append(two)
        lengths.setdefault(digits, []).append(two)

    def one_of(twos, digits):
        return f"(?:{'|'.join(twos)})" + f"[0-9]{{{digits - 2}}}" * (digits > 2)

    identifier = "|".join(one_of(twos, digits) for digits, twos in lengths.items())
    fields = "|".join(one_of(twos, digits) + (f"[0-9]{{{size}}}" if size else f"[^{_GS}]+") for (digits, size), twos in shapes.items())
    return rf"\G{_GS}*(?=({identifier}))(?:{fields})"


def _reason(rest):
    """Why the field at the start of `rest` cannot be read."""
    rule = F.try_element_at(_rules(), F.substring(rest, 1, 2))
    digits = F.coalesce(rule["digits"], F.lit(2))
    ai, body = F.substring(rest, F.lit(1), digits), F.substring(rest, digits + 1, F.length(rest))
    value = F.substring(body, F.lit(1), rule["size"])
    return (
        F.when(rule.isNull() | ~F.rlike(ai, F.lit(r"\A[0-9]+\z")) | (F.length(ai) < rule["digits"]), F.concat(
            F.lit("UNKNOWN_IDENTIFIER:"), F.substring(rest, 1, 2)))
        .when(rule["size"] == 0, F.concat(F.lit("EMPTY:"), ai))
        .when(F.length(value) < rule["size"], F.concat(F.lit("TOO_SHORT:"), ai))
        .otherwise(F.concat(F.lit("NOT_DIGITS:"), ai)))


def gs1_fields(scans, missing_mark=None, excess_codes=None):
    """Adds `fields`, MAP of identifier to value, and `reason`, why reading stopped (NULL where all was read).

    The repaired text is a sequence of fields. The first two digits of a field tell the length of its
    identifier and whether its data has a set length or runs to the next separator. Of an identifier that occurs
    twice the first value counts. What cannot be read ends it: UNKNOWN_IDENTIFIER, TOO_SHORT, NOT_DIGITS or EMPTY,
    with the identifier; fields before it are kept. An empty or blank text has no fields and the reason NO_TEXT.
    Separators and a symbology prefix in front are ignored. A text is passed over once, whatever its number of fields.
    """
    separated = computed_once(separated_text(scans, missing_mark, excess_codes), {"element": F.col("text")})
    pattern = F.lit(_field_pattern())
    read = computed_once(separated, {name: F.regexp_extract_all("element", pattern, F.lit(group)) for group, name in enumerate(("matched", "ais"))})
    rest = F.ltrim(F.substring("element", F.length(F.array_join("matched", "")) + 1, F.length("element")), F.lit(_GS))
    # the value stands behind the identifier, in front of which there are separators only
    values = F.zip_with("matched", "ais", lambda m, ai: F.substring(m, F.instr(m, ai) + F.length(ai), F.length(m)))
    read = computed_once(read, {"rest": rest, "values": values})
    own = F.col("ais")
    first = F.filter(F.arrays_zip("ais", "values"), lambda f, i: F.array_position(own, f["ais"]) == i + 1)
    fields = F.when(F.size(F.array_distinct(own)) < F.size(own), F.map_from_entries(first)).otherwise(F.map_from_arrays("ais", "values"))
    reason = F.when(F.trim("element") == "", "NO_TEXT").when(F.col("rest") != "", _reason(F.col("rest")))
    return read.select(*scans.columns, fields.alias("fields"), reason.alias("reason"))
