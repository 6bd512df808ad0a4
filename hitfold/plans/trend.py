"""Gap-filled series per site, their comparison and summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitfold.functions import clock
from hitfold.functions.sketch import unique_counts
from hitfold.plans.overview import TOTALS, change_pct, hours_of, zero_filled
from hitfold.plans.periods import Period, of_sites, spine, within


def _dense_sums(
    table: DataFrame, sites: int | DataFrame, period: Period, measures: tuple[str, ...]
) -> DataFrame:
    """Sums per (site, bucket) with a zero row for every bucket.

    The spine joins in as zero partials, so filling gaps needs no join.
    """
    rows = within(of_sites(table, sites), "minute_ts", period.start, period.end).select(
        "site_id", clock.bucket("minute_ts", period.bucket).alias("timestamp"), *measures
    )
    zeros = spine(table.sparkSession, sites, period).select(
        "site_id", "timestamp", *[F.lit(0).cast("bigint").alias(m) for m in measures]
    )
    return (
        rows.unionByName(zeros)
        .groupBy("site_id", "timestamp")
        .agg(*[F.sum(m).alias(m) for m in measures])
    )


def trend(
    metric: DataFrame, uniques: DataFrame, sites: int | DataFrame, period: Period
) -> DataFrame:
    """Totals and distinct counts per site and bucket, every bucket present.

    A sketch belongs to the bucket that holds its hour's start.
    """
    sums = _dense_sums(metric, sites, period, TOTALS)
    hours = hours_of(of_sites(uniques, sites), period).withColumn(
        "timestamp", clock.bucket("hour_ts", period.bucket)
    )
    visitors = unique_counts(hours, ["site_id", "timestamp"])
    return zero_filled(sums.join(visitors, ["site_id", "timestamp"], "left"), "uv", "ip")


def spider_trend(spider_minute: DataFrame, sites: int | DataFrame, period: Period) -> DataFrame:
    return _dense_sums(spider_minute, sites, period, ("requests",))


def with_series(rows: DataFrame, period: Period) -> DataFrame:
    """Derived series: requests per second of the bucket, and traffic."""
    return rows.withColumns(
        {
            "qps": F.col("requests") / F.lit(float(max(1, period.bucket))),
            "realtime_bytes": F.col("body_bytes"),
        }
    )


def _position(ts: str, period: Period):
    first = period.start - period.start % period.bucket
    return ((F.col(ts) - F.lit(first)) / F.lit(period.bucket)).cast("bigint")


def compare_trend(
    current: DataFrame, previous: DataFrame, period: Period, measure: str = "requests"
) -> DataFrame:
    """The two series side by side, aligned by position; missing values are 0.

    A dense series has its position in its timestamp, so no window is needed.
    """
    now = current.select(
        "site_id", _position("timestamp", period).alias("position"),
        F.col("timestamp").alias("now_ts"), F.col(measure).alias("current"),
    )
    then = previous.select(
        "site_id", _position("timestamp", period.previous()).alias("position"),
        F.col("timestamp").alias("then_ts"), F.col(measure).alias("previous"),
    )
    joined = zero_filled(now.join(then, ["site_id", "position"], "full"), "current", "previous")
    return joined.select(
        "site_id", "position", F.coalesce("now_ts", "then_ts").alias("timestamp"),
        "current", "previous",
        change_pct(F.col("current"), F.col("previous")).alias("change_pct"),
    )


def summarize(compared: DataFrame) -> DataFrame:
    """Sum, mean, peak, first time of the peak and change against the previous sum."""
    peak = F.max(F.struct(F.col("current"), -F.col("position"), "timestamp"))
    return (
        compared.groupBy("site_id")
        .agg(
            F.sum("current").alias("total"),
            F.avg("current").alias("average"),
            peak.alias("_peak"),
            F.sum("previous").alias("previous_total"),
        )
        .select(
            "site_id", "total", "average",
            F.greatest(F.col("_peak.current"), F.lit(0)).alias("peak"),
            F.col("_peak.timestamp").alias("peak_time"),
            "previous_total",
            change_pct(F.col("total"), F.col("previous_total")).alias("change_pct"),
        )
    )
