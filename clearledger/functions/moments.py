"""Time-of-day and timestamp strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accepted shapes of declared time and timestamp strings.
TIME_PATTERN = r"^(([01][0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9])?|24:00(:00)?)$"
TIMESTAMP_PATTERN = r"^\s*\d{4}-\d{2}-\d{2}"


def time_of_day(c: Column) -> Column:
    """``HH:MM`` or ``HH:MM:SS`` as ``HH:MM:SS`` text; anything else is NULL."""
    return F.when(c.rlike(TIME_PATTERN), F.rpad(c, 8, ":00"))


def timestamp_or_null(c: Column) -> Column:
    """Parse each value on its own; unreadable ones become NULL.

    The pattern keeps out bare years, which a plain cast would accept.
    """
    return F.when(c.rlike(TIMESTAMP_PATTERN), c.try_cast("timestamp_ntz"))


def month_start(c: Column) -> Column:
    """First day of the month; by way of dates, so that no time zone has a say."""
    return F.trunc(c.cast("date"), "month").cast("timestamp_ntz")


def month_label(c: Column) -> Column:
    return F.date_format(c, "MMM yyyy")


def iso_timestamp(c: Column, separator: str = "T") -> Column:
    """ISO text of a zoneless timestamp, with six decimals only where there are any."""
    shown = c.cast("string")
    point = F.instr(shown, ".")
    padded = F.when(point > 0, F.rpad(shown, point + 6, "0")).otherwise(shown)
    return padded if separator == " " else F.replace(padded, F.lit(" "), F.lit(separator))


def iso_zoned_timestamp(c: Column, separator: str = "T") -> Column:
    """The same for a timestamp with zone: session time and its offset."""
    return F.concat(iso_timestamp(c, separator), F.date_format(c, "xxx"))
