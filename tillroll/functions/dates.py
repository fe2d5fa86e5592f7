"""Calendar columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weekday names in report order.
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def month_start(ts: Column) -> Column:
    return F.trunc(ts, "MM")


def month_label(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def hour_of_day(ts: Column) -> Column:
    return F.hour(ts)


def weekday_name(ts: Column) -> Column:
    return F.date_format(ts, "EEEE")


def elapsed_days(later: Column, earlier: Column) -> Column:
    """Whole 24-hour units between two zone-free timestamps (not calendar days)."""
    return F.extract(F.lit("DAY"), later - earlier).cast("bigint")


def month_end(month: Column) -> Column:
    """Last microsecond of the month that starts on the date `month`."""
    following = F.add_months(month, 1).cast("timestamp_ntz")
    return following - F.expr("INTERVAL '0.000001' SECOND")
