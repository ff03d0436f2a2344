"""Time expressions. Timestamps are zone-free (``timestamp_ntz``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Timestamp layouts that the tolerant parser tries, in this order.
TIMESTAMP_FORMATS = (
    "yyyy/MM/dd HH:mm:ss",
    "MM/dd/yy HH:mm:ss",
    "MM/dd/yyyy HH:mm:ss",
    "MM/dd/yyyy HH:mm",
    "yyyy/MM/dd",
    "MM/dd/yyyy",
)


def epoch_to_timestamp(seconds: Column) -> Column:
    """Epoch seconds (number or text) to a naive UTC timestamp; a bad value gives NULL."""
    micros = F.round(seconds.try_cast("double") * 1_000_000).try_cast("bigint")
    base = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return base + F.make_dt_interval(secs=(micros / 1_000_000).cast("decimal(18,6)"))


def parse_timestamp(text: Column, formats: Sequence[str] = TIMESTAMP_FORMATS) -> Column:
    """Tolerant parse of mixed layouts to a naive UTC timestamp; a bad value gives NULL.

    An offset (``Z``, ``+02:00``) is applied and removed. Digits beyond
    microseconds are cut off.
    """
    trimmed = F.regexp_replace(F.trim(text), r"(\.\d{6})\d+", "$1")
    has_offset = trimmed.rlike(r"\d(Z|[+-]\d{2}:?\d{2})$") & trimmed.rlike(r"\d:\d")
    zoned = F.convert_timezone(
        F.current_timezone(), F.lit("UTC"), trimmed.try_cast("timestamp").cast("timestamp_ntz")
    )
    # the session zone cancels out: the instant is shown in it and moved to UTC
    naive = F.when(has_offset, zoned).otherwise(trimmed.try_cast("timestamp_ntz"))
    tried = [F.try_to_timestamp(trimmed, F.lit(f)).cast("timestamp_ntz") for f in formats]
    return F.coalesce(naive, *tried)


def date_and_time(day: Column, clock: Column) -> Column:
    """A timestamp from a date column and a time-of-day column."""
    return parse_timestamp(F.concat_ws(" ", day.cast("string"), clock.cast("string")))


def format_timestamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy/MM/dd HH:mm:ss")


def day_name(ts: Column) -> Column:
    return F.date_format(ts, "EEEE")


def month_name(ts: Column) -> Column:
    return F.date_format(ts, "MMMM")


def is_midnight(ts: Column) -> Column:
    return ts == F.to_date(ts).cast("timestamp_ntz")


def seconds_of_day(ts: Column) -> Column:
    """Seconds since midnight, with fractions."""
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.extract(F.lit("SECOND"), ts).cast("double")


def assigned_timestamp(ts: Column, cutoff_hour: int = 2) -> Column:
    """Before the cut-off hour a moment belongs to the day before; its time of day is kept."""
    return F.when(F.hour(ts) < cutoff_hour, ts - F.expr("interval 1 day")).otherwise(ts)


def assigned_date(ts: Column, cutoff_hour: int = 2) -> Column:
    return F.to_date(assigned_timestamp(ts, cutoff_hour))


def micros(ts: Column) -> Column:
    """Microseconds since 1970-01-01 00:00, for exact arithmetic on naive timestamps.

    In a session zone other than UTC the count is put together from day and
    time of day, because a naive moment can be missing or double in that zone.
    """
    session = SparkSession.getActiveSession()
    if session is not None and session.conf.get("spark.sql.session.timeZone") in ("UTC", "Etc/UTC", "Z", "+00:00"):
        return F.unix_micros(ts.cast("timestamp"))
    in_day = (F.hour(ts) * 3600 + F.minute(ts) * 60).cast("bigint") * 1_000_000
    second = (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")
    return F.unix_date(F.to_date(ts)).cast("bigint") * 86_400_000_000 + in_day + second


def seconds_between(later: Column, earlier: Column) -> Column:
    return (micros(later) - micros(earlier)) / 1_000_000
