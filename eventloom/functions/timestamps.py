"""Timestamp parsing into UTC ``TIMESTAMP_NTZ``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ISO-8601 date-time whose offset is mandatory; seconds and fraction may be missing.
OFFSET_DATE_TIME = r"^\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?([Zz]|[+-]\d{2}:\d{2})$"
INSTANT = r"^\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(\.\d{1,9})?([Zz]|[+-]\d{2}:\d{2})$"


def instant_to_utc(instant: Column) -> Column:
    """UTC wall-clock NTZ of an instant, whatever the session time zone."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(instant), F.expr("timestamp_ntz'1970-01-01 00:00:00'"))


def _with_seconds(text: Column) -> Column:
    return F.regexp_replace(F.upper(text), r"^(.{10}T\d{2}:\d{2})([Z+-])", "$1:00$2")


def parse_offset_timestamp(text: Column) -> Column:
    """UTC value of an ISO-8601 text with offset; NULL otherwise (naive text is rejected)."""
    return F.when(text.rlike(OFFSET_DATE_TIME), instant_to_utc(_with_seconds(text).try_cast("timestamp")))


def parse_lenient_timestamp(text: Column) -> Column:
    """Instant if the text is one, else its first 19 characters as a UTC local time, else NULL."""
    instant = F.when(text.rlike(INSTANT), instant_to_utc(F.upper(text).try_cast("timestamp")))
    local = F.substring(F.replace(text, F.lit("T"), F.lit(" ")), 1, 19)
    naive = F.when(local.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"), local.try_cast("timestamp_ntz"))
    return F.coalesce(instant, naive)


def local_date(text: Column) -> Column:
    """Calendar date of an ISO-8601 text in its own offset."""
    return F.substring(text, 1, 10).try_cast("date")


def as_utc(value) -> Column:
    """A clock argument (text or column) as NTZ."""
    return value if isinstance(value, Column) else F.lit(value).cast("timestamp_ntz")


def seconds_before(as_of, seconds: int) -> Column:
    return F.timestamp_add("SECOND", F.lit(-int(seconds)), as_utc(as_of))
