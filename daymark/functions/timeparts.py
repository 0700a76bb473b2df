"""Zone-free time arithmetic on TIMESTAMP_NTZ columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"
_DAY_US = 86_400_000_000


def day(ts: Column) -> Column:
    return F.to_date(ts)


def off_hours(hour: Column) -> Column:
    """Before 7 or after 19 o'clock."""
    return ((hour < 7) | (hour > 19)).cast("int")


def micros(ts: Column) -> Column:
    """Microseconds since 1970, without going through the session zone."""
    date_us = F.unix_date(F.to_date(ts)).cast("long") * F.lit(_DAY_US)
    clock_us = (F.hour(ts) * 3600 + F.minute(ts) * 60).cast("long") * F.lit(1_000_000)
    second_us = (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("long")
    return date_us + clock_us + second_us


def plus_micros(us: Column, base: str = EPOCH) -> Column:
    """``base`` plus a number of microseconds; null for null."""
    seconds = (us.cast("decimal(24,0)") / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(18,6)")
    return F.expr(base) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def plus_seconds(seconds: Column, base: str = EPOCH) -> Column:
    return F.expr(base) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))


def utc_micros(text: Column) -> Column:
    """Microseconds of an ISO-8601 text; an offset is honoured, none means UTC; null if unreadable."""
    trimmed = F.trim(text)
    zoned = trimmed.rlike(r"(?i)(Z|[+-]\d{2}:?\d{2})$") & trimmed.rlike(r"\d:\d")
    dated = F.when(trimmed.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(trimmed, F.lit("T00:00:00"))).otherwise(trimmed)
    return F.unix_micros(F.try_to_timestamp(F.when(zoned, dated).otherwise(F.concat(dated, F.lit("Z")))))


def mixed_micros(text: Column) -> Column:
    """Epoch milliseconds (over 1e12), epoch seconds (over 1e9) or ISO text, in microseconds."""
    number = F.when(F.trim(text).rlike(r"^[+-]?\d+(\.\d+)?([eE][+-]?\d+)?$"), F.trim(text).try_cast("double"))
    scaled = F.when(number > 1e12, number * 1_000).when(number > 1e9, number * 1_000_000)
    return F.when(number.isNotNull(), F.round(scaled).cast("long")).otherwise(utc_micros(text))
