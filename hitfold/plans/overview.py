"""Totals per site: overview, site summaries, period comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitfold.functions import clock
from hitfold.functions.columns import ratio_pct
from hitfold.functions.sketch import unique_counts
from hitfold.operators import sites as S
from hitfold.plans.periods import Period, of_sites, site_rows, within
from hitfold.schema import METRIC_MINUTE

TOTALS = METRIC_MINUTE.sums
METRICS = ("pv", "uv", "ip", "requests", "body_bytes", "errors", "bot_requests",
           "realtime_bytes", "qps")


def zero_filled(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in columns})


def two_digits(value: Column) -> Column:
    return F.rint(value * 100) / 100


def percent(part: str, whole: str) -> Column:
    """Percentage with two digits, half-even."""
    return two_digits(ratio_pct(F.col(part), F.col(whole)))


def hours_of(uniques: DataFrame, period: Period) -> DataFrame:
    """Sketch hours touching the period: from the hour that holds its start."""
    return within(uniques, "hour_ts", period.start - period.start % 3600, period.end)


def _totals(metric: DataFrame, period: Period, keys: list[str]) -> DataFrame:
    """Sums, the last minute and what happened in it."""
    minutes = (
        within(metric, "minute_ts", period.start, period.end)
        .groupBy(*keys, "minute_ts")
        .agg(*[F.sum(c).alias(c) for c in TOTALS])
    )
    latest = F.max_by(F.struct("requests", "body_bytes"), "minute_ts")
    return minutes.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in TOTALS],
        F.max("minute_ts").alias("last_seen"),
        latest.alias("_latest"),
    )


def summaries(
    metric: DataFrame, uniques: DataFrame, sites: int | DataFrame, period: Period
) -> DataFrame:
    """One row per requested site, zeros where it has no traffic."""
    totals = _totals(of_sites(metric, sites), period, ["site_id"])
    visitors = unique_counts(hours_of(of_sites(uniques, sites), period), ["site_id"])
    joined = (
        site_rows(metric.sparkSession, sites)
        .join(totals, "site_id", "left")
        .join(visitors, "site_id", "left")
    )
    filled = zero_filled(
        joined.withColumns(
            {
                "realtime_bytes": F.col("_latest.body_bytes"),
                "_last_requests": F.col("_latest.requests"),
            }
        ),
        *TOTALS, "uv", "ip", "last_seen", "realtime_bytes", "_last_requests",
    )
    return filled.select(
        "site_id", *TOTALS, "uv", "ip", "realtime_bytes",
        two_digits(F.col("_last_requests") / F.lit(60.0)).alias("qps"),
        "last_seen",
        percent("errors", "requests").alias("error_rate"),
    )


def overview(
    metric: DataFrame, uniques: DataFrame, sites: int | DataFrame, period: Period
) -> DataFrame:
    return summaries(metric, uniques, sites, period).drop("last_seen", "error_rate")


def site_list(
    registry: DataFrame, metric: DataFrame, uniques: DataFrame, period: Period,
    query: str = "", sort: str = "name", descending: bool = False,
) -> DataFrame:
    """Active sites with their figures, searched and sorted."""
    shown = S.search(S.active(registry), query).withColumnRenamed("id", "site_id")
    figures = summaries(metric, uniques, shown, period)
    rows = shown.select("site_id", "panel_site_id", "name", "web_server").join(figures, "site_id")
    return S.sort_sites(rows, sort, descending)


def change_pct(current: Column, previous: Column) -> Column:
    """Relative change in percent, null without a previous value."""
    return F.when(
        previous > 0,
        (current.cast("double") - previous.cast("double")) / previous.cast("double") * 100,
    )


def _in_period(ts: Column, current: Period, hourly: bool) -> Column:
    """The names of the periods a row belongs to (the hour at the seam counts for both)."""
    tests = []
    for name, p in (("current", current), ("previous", current.previous())):
        start = p.start - p.start % 3600 if hourly else p.start
        tests.append(F.when((ts >= start) & (ts < p.end), F.lit(name)))
    return F.explode(F.array_compact(F.array(*tests)))


def compare(
    metric: DataFrame, uniques: DataFrame, sites: int | DataFrame, current: Period
) -> DataFrame:
    """Each metric of a site now, in the period before, and its change in percent.

    Both periods come from one scan of each table.
    """
    both = Period(current.previous().start, current.end, current.bucket, current.timezone)
    labelled = within(of_sites(metric, sites), "minute_ts", both.start, both.end).withColumn(
        "period", _in_period(F.col("minute_ts"), current, False)
    )
    totals = _totals(labelled, both, ["site_id", "period"])
    hours = hours_of(of_sites(uniques, sites), both).withColumn(
        "period", _in_period(F.col("hour_ts"), current, True)
    )
    visitors = unique_counts(hours, ["site_id", "period"])
    per_period = totals.join(visitors, ["site_id", "period"], "full").select(
        "site_id", "period", *TOTALS, "uv", "ip",
        F.col("_latest.body_bytes").alias("realtime_bytes"),
        two_digits(F.col("_latest.requests") / F.lit(60.0)).alias("qps"),
    )
    pair = lambda m: F.struct(
        F.lit(m).alias("metric"),
        *[
            F.coalesce(F.max(F.when(F.col("period") == name, F.col(m))), F.lit(0))
            .cast("double")
            .alias(name)
            for name in ("current", "previous")
        ],
    )
    wide = (
        site_rows(metric.sparkSession, sites)
        .join(per_period, "site_id", "left")
        .groupBy("site_id")
        .agg(*[pair(m).alias(m) for m in METRICS])
    )
    return wide.select("site_id", F.inline(F.array(*METRICS))).withColumn(
        "change_pct", change_pct(F.col("current"), F.col("previous"))
    )


def sites_with_statistics(metric: DataFrame) -> DataFrame:
    return metric.select("site_id").distinct()


def has_statistics(metric: DataFrame, site_id: int | None = None) -> bool:
    rows = metric if site_id is None else of_sites(metric, site_id)
    return not rows.select("site_id").limit(1).isEmpty()


def unique_days(values: DataFrame, tz: str = "UTC") -> DataFrame:
    """Exact distinct per site and local day, from rows (site_id, hour_ts, kind, value)."""
    return unique_counts(values.withColumn("day", clock.local_day("hour_ts", tz)), ["site_id", "day"])
