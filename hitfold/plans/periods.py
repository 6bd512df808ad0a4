"""Reporting periods and range filters."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PERIODS = ("today", "yesterday", "7d", "30d")
HOUR, DAY = 3600, 86400


@dataclass(frozen=True)
class Period:
    start: int
    end: int
    bucket: int = HOUR
    timezone: str = "UTC"

    def previous(self) -> "Period":
        """The range of equal length just before this one."""
        length = self.end - self.start
        return Period(self.start - length, self.start, self.bucket, self.timezone)

    def days(self) -> tuple[str, str]:
        """First and last local day touched."""
        text = lambda ts: datetime.fromtimestamp(ts, ZoneInfo(self.timezone)).strftime("%Y-%m-%d")
        return text(self.start), text(max(self.start, self.end - 1))


def period_range(period: str, now: float, tz: str = "UTC", exact: bool = False) -> Period:
    """Range of a named period; an unknown name means today.

    The end lies one second after the last instant meant, so ``yesterday`` also takes
    the first minute of today, and day tables take all of today. ``exact`` ends at midnight instead.
    """
    moment = datetime.fromtimestamp(now, ZoneInfo(tz))
    today = moment.replace(hour=0, minute=0, second=0, microsecond=0)
    first, last, bucket = {
        "yesterday": (today - timedelta(days=1), today, HOUR),
        "7d": (today - timedelta(days=6), moment, DAY),
        "30d": (today - timedelta(days=29), moment, DAY),
    }.get(period, (today, moment, HOUR))
    extra = 0 if exact and period == "yesterday" else 1
    return Period(int(first.timestamp()), int(last.timestamp()) + extra, bucket, tz)


def within(df: DataFrame, column: str, start: int, end: int) -> DataFrame:
    """Rows with ``start <= column < end``.

    Where the table has a ``day`` partition column, a day filter one day wider on each
    side (any zone) lets Spark skip partitions.
    """
    kept = df.where((F.col(column) >= start) & (F.col(column) < end))
    if "day" in df.columns:
        day = lambda ts: F.date_from_unix_date(F.lit(ts // DAY))
        kept = kept.where(F.col("day").between(day(start - DAY), day(end + DAY)))
    return kept


def of_sites(df: DataFrame, sites: int | DataFrame) -> DataFrame:
    """Rows of one site, or of all sites of a DataFrame with one row per ``site_id``."""
    if isinstance(sites, int):
        return df.where(F.col("site_id") == sites)
    return df.join(sites.select("site_id"), "site_id", "left_semi")


def site_rows(spark: SparkSession, sites: int | DataFrame) -> DataFrame:
    if isinstance(sites, int):
        return spark.range(sites, sites + 1).select(F.col("id").alias("site_id"))
    return sites.select(F.col("site_id").cast("bigint").alias("site_id"))


def spine(spark: SparkSession, sites: int | DataFrame, period: Period) -> DataFrame:
    """Every (site, bucket) of the period."""
    first = period.start - period.start % period.bucket
    starts = F.sequence(
        F.lit(first).cast("bigint"),
        F.lit(max(first, period.end - 1)).cast("bigint"),
        F.lit(period.bucket).cast("bigint"),
    )
    return site_rows(spark, sites).select("site_id", F.explode(starts).alias("timestamp"))
