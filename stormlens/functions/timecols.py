"""Time-base conversions. Timestamps without zone are read as UTC; the session zone must be UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stormlens.functions.geo import _c

DAY_US = 86_400_000_000
HOUR_US = 3_600_000_000


def micros(ts) -> Column:
    """Exact integer microseconds since the epoch."""
    return F.unix_micros(_c(ts).cast("timestamp"))


def epoch_seconds(ts) -> Column:
    return micros(ts) / 1e6


def from_micros(us) -> Column:
    return F.timestamp_micros(_c(us))


def from_millis(ms) -> Column:
    return F.timestamp_millis(_c(ms).cast("bigint"))


def from_nanos(ns) -> Column:
    return F.timestamp_micros((_c(ns).cast("decimal(20,0)") / 1000).cast("bigint"))


def iso_epoch(text) -> Column:
    """ISO-8601 text (with Z or an offset) to epoch seconds; null when unparsable."""
    return epoch_seconds(F.try_to_timestamp(_c(text)))


def day_no(us) -> Column:
    """UTC day number of integer microseconds."""
    return F.floor(_c(us) / F.lit(DAY_US)).cast("bigint")


def hour_no(us) -> Column:
    return F.floor(_c(us) / F.lit(HOUR_US)).cast("bigint")


def day_text(us) -> Column:
    return F.date_format(from_micros(us), "yyyy-MM-dd")


def month_text(us) -> Column:
    return F.date_format(from_micros(us), "yyyy-MM")


# The layouts a granule's "seconds since ..." base time may have.
UNITS_FORMATS = [
    "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "yyyy-MM-dd'T'HH:mm:ss",
]


def units_base_epoch(units) -> Column:
    """Epoch seconds of the base time named in '<unit> since <time>'."""
    stamp = F.trim(F.replace(F.regexp_extract(_c(units), r"since(.*)$", 1), F.lit("Z"), F.lit("")))
    tries = [F.try_to_timestamp(stamp, F.lit(f)) for f in UNITS_FORMATS]
    return epoch_seconds(F.coalesce(*tries))


def clock_to_epoch(hms, day, rollover_hour: int = 12) -> Column:
    """HH:MM:SS text on an evening that starts on `day`; early hours belong to the next day."""
    h = F.split_part(_c(hms), F.lit(":"), F.lit(1)).cast("int")
    m = F.split_part(_c(hms), F.lit(":"), F.lit(2)).cast("int")
    s = F.split_part(_c(hms), F.lit(":"), F.lit(3)).cast("double")
    base = F.unix_date(_c(day).cast("date")) + F.when(h < rollover_hour, 1).otherwise(0)
    return base * 86400.0 + h * 3600 + m * 60 + s
