"""Wall-clock time: everything is ``timestamp_ntz``, so that no session zone or daylight saving changes a result."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def parts_timestamp(year: Column, month: Column, day: Column, hour: Column) -> Column:
    """A timestamp from its parts; NULL if they make none."""
    text = F.concat_ws("-", year.cast("string"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0"))
    text = F.concat(text, F.lit(" "), F.lpad(hour.cast("string"), 2, "0"), F.lit(":00:00"))
    return F.when(year.isNotNull() & month.isNotNull() & day.isNotNull() & hour.isNotNull(), text.try_cast("timestamp_ntz"))


def text_timestamp(date: Column, time: Column | None = None) -> Column:
    """A timestamp from a date and, if given, a time of day as text; NULL if they make none."""
    return (date if time is None else F.concat_ws(" ", date, time)).try_cast("timestamp_ntz")


def local_hour(ts: Column) -> Column:
    """The hour that the wall clock showed."""
    return F.make_timestamp_ntz(F.year(ts), F.month(ts), F.dayofmonth(ts), F.hour(ts), F.lit(0), F.lit(0))


def ntz(moment: datetime | str) -> Column:
    return F.lit(str(moment)).cast("timestamp_ntz")


def in_period(ts: Column, start: datetime | str, end: datetime | str) -> Column:
    """Start included, end excluded."""
    return (ts >= ntz(start)) & (ts < ntz(end))


def minutes_between(start: Column, end: Column) -> Column:
    return (F.unix_timestamp(end.cast("timestamp")) - F.unix_timestamp(start.cast("timestamp"))) / 60.0


def calendar(ts: Column) -> dict[str, Column]:
    """Partition columns."""
    return {"year": F.year(ts), "month": F.month(ts)}


def split_label(ts: Column, validation_start: datetime | str, test_start: datetime | str) -> Column:
    return F.when(ts < ntz(validation_start), "train").when(ts < ntz(test_start), "validation").otherwise("test")


def between_months(start: datetime, end: datetime, ts: str, year: str = "year", month: str = "month") -> Column:
    """The period, and the same by partition columns, so that a partitioned table is pruned."""
    first, last = start.year * 12 + start.month, end.year * 12 + end.month
    return in_period(F.col(ts), start, end) & (F.col(year) * 12 + F.col(month)).between(first, last)
