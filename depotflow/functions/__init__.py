from .bounded import inline_rows
from .calendar import forecast_windows, month_range, year_month
from .geo import geo_distance_km
from .once import computed_once
from .text import clock_text, is_blank, like_text, parse_coord

__all__ = [
    "clock_text", "computed_once", "forecast_windows", "geo_distance_km", "inline_rows",
    "is_blank", "like_text", "month_range", "parse_coord", "year_month",
]
