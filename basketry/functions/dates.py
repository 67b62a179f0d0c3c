"""Date and time helpers with the calendar semantics the analytics rely on.

All timestamps are kept as ``timestamp_ntz`` (wall-clock, no zone), so results do
not depend on the session time zone of whoever runs the job.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The source files write timestamps day-first with a two-digit year,
# e.g. "07-08-18 15:27"; one-digit days, months and hours ("7-8-18 9:05") are accepted.
DAY_FIRST = r"^\d{1,2}-\d{1,2}-\d{2} \d{1,2}:\d{2}$"
# Two-digit years 69..99 belong to the 1900s (the pandas / C strptime pivot).
TWO_DIGIT_YEAR_PIVOT = 69


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_day_first(text) -> Column:
    """Parse day-first text to ``timestamp_ntz``; unparsable text becomes NULL.

    The text is cut into its five numbers once, and ``try_make_timestamp_ntz`` puts them
    together without any session time zone (no DST shifts); it gives NULL for a date or
    time that doesn't exist.
    """
    c = _col(text)
    year = lambda p: F.when(p[2] >= TWO_DIGIT_YEAR_PIVOT, p[2] + 1900).otherwise(p[2] + 2000)
    made = F.transform(
        F.array(F.split(c, "[- :]").cast("array<int>")),
        lambda p: F.try_make_timestamp_ntz(year(p), p[1], p[0], p[3], p[4], F.lit(0)),
    )[0]
    return F.when(F.rlike(c, F.lit(DAY_FIRST)), made)


def calendar_days(end, start) -> Column:
    """Number of calendar-day boundaries between two timestamps (23:00 -> 01:00 is 1).

    This is SQL ``DATEDIFF('day', start, end)``; note the reversed argument order
    of Spark's two-argument ``datediff``.
    """
    return F.datediff(F.to_date(_col(end)), F.to_date(_col(start))).cast("bigint")


def month_start(ts) -> Column:
    """First day of the timestamp's month as a DATE (zone independent)."""
    return F.trunc(F.to_date(_col(ts)), "month")


def hours(n) -> Column:
    return F.make_dt_interval(hours=_col(n).cast("int"))


def days(n) -> Column:
    return F.make_dt_interval(days=_col(n).cast("int"))
