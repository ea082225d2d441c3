"""Text expressions."""

from pyspark.sql import functions as F

# The characters Unicode counts as white space.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def is_blank(col):
    """NULL, empty, or white space only."""
    return F.coalesce(F.btrim(col, F.lit(WHITE_SPACE)) == "", F.lit(True))


def like_text(col, text):
    """Substring match in which `%` and `_` are wildcards and a backslash is plain text.

    The escape character is moved to one that does not occur in the data.
    """
    return F.like(F.col(col), F.lit(f"%{text}%"), F.lit("\x01"))


def parse_coord(col):
    """`"lon,lat"` text as a struct (lat, lon); both NULL unless both are finite degrees in range."""
    col = F.col(col) if isinstance(col, str) else col
    parts = F.split(col, ",")
    lon = F.try_element_at(parts, F.lit(1)).try_cast("double")
    lat = F.try_element_at(parts, F.lit(2)).try_cast("double")
    usable = usable_degrees(lat, lon)
    return F.struct(F.when(usable, lat).alias("lat"), F.when(usable, lon).alias("lon"))


def usable_degrees(lat, lon):
    return (F.abs(lon) <= 180) & (F.abs(lat) <= 90)  # NaN is above every number


def clock_text(minutes, start_hour):
    """Minutes after the start hour as HH:MM. Hours run on past 24."""
    hours = F.lit(start_hour) + F.floor(minutes / 60)
    return F.format_string("%02d:%02d", hours.cast("bigint"), F.pmod(minutes, F.lit(60)))
