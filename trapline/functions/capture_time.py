"""Capture times (`TIMESTAMP_NTZ`) and their cyclic encodings."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Days before each month of a leap year.
DAYS_BEFORE_MONTH = [0, 31, 60, 91, 121, 152, 182, 213, 244, 274, 305, 335]
# The readings that close each cycle.
DAY_SPAN = 366.0
HOUR_SPAN = 23.0
MINUTE_SPAN = 59.0
SECOND_SPAN = 59.0


def parse_capture_time(text: Column) -> Column:
    """The clock reading in the text, whatever the session's time zone; an offset behind it is not applied.

    Null when the text is no timestamp; callers set such rows apart.
    """
    return text.try_cast("timestamp_ntz")


def time_of_day(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm:ss")


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970 of the local clock reading, exact and in no time zone at all."""
    days = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    micros = (F.date_part(F.lit("SECOND"), ts) * 1000000).cast("bigint")
    return (days * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60) * 1000000 + micros


def leap_day_index(ts: Column) -> Column:
    """0-based day in a leap-year calendar, whatever the year."""
    table = F.array(*[F.lit(d) for d in DAYS_BEFORE_MONTH])
    return F.element_at(table, F.month(ts)) + F.dayofmonth(ts) - 1


def cyclic_encode(x: Column) -> tuple[Column, Column]:
    angle = F.lit(math.pi) * (F.lit(2.0) * x - F.lit(1.0))
    return (F.sin(angle) + 1.0) / 2.0, (F.cos(angle) + 1.0) / 2.0


def time_shares(ts: Column) -> dict[str, Column]:
    return {
        "day_share": leap_day_index(ts) / F.lit(DAY_SPAN),
        "hour_share": F.hour(ts) / F.lit(HOUR_SPAN),
        "minute_share": F.minute(ts) / F.lit(MINUTE_SPAN),
        "second_share": F.second(ts) / F.lit(SECOND_SPAN),
    }


def chord(share_a: Column, share_b: Column) -> Column:
    """Distance between two cyclic encodings: they lie on a circle of radius one half."""
    return F.abs(F.sin(F.lit(math.pi) * (share_a - share_b)))
