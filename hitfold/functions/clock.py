"""Epoch seconds to minutes, hours, buckets and local days."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _name(ts: Column | str) -> Column:
    return F.col(ts) if isinstance(ts, str) else ts


def bucket(ts: Column | str, seconds: int) -> Column:
    """Start of the epoch-aligned bucket holding ``ts``."""
    ts = _name(ts)
    return ts - F.pmod(ts, F.lit(seconds).cast("bigint"))


def minute(ts: Column | str) -> Column:
    return bucket(ts, 60)


def hour(ts: Column | str) -> Column:
    return bucket(ts, 3600)


def epoch_ntz(ts: Column | str) -> Column:
    """UTC wall-clock time without zone, independent of the session zone."""
    return F.timestamp_add("SECOND", _name(ts), F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"))


def local_ntz(ts: Column | str, tz: str = "UTC") -> Column:
    wall = epoch_ntz(ts)
    if tz.upper() in ("UTC", "Z", "ETC/UTC"):
        return wall
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), wall)


def local_day(ts: Column | str, tz: str = "UTC") -> Column:
    """Local calendar day as DATE (4 bytes in a shuffle, unlike its text)."""
    if tz.upper() in ("UTC", "Z", "ETC/UTC"):
        return F.date_from_unix_date(F.floor(_name(ts) / F.lit(86400)).cast("int"))
    return local_ntz(ts, tz).cast("date")


def ntz_epoch(column: Column | str) -> Column:
    """Epoch seconds of a zone-less timestamp, read as UTC."""
    return F.timestamp_diff(
        "SECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), _name(column)
    )
