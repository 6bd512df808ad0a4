"""Crawlers, clients and the top addresses and paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hitfold.functions.columns import ratio_pct
from hitfold.operators.geo import with_location
from hitfold.operators.rollup import CLIENT_DIMENSIONS
from hitfold.plans.overview import percent
from hitfold.plans.periods import Period, of_sites, site_rows, within

RANK_LIMIT = 100
REPORT_LIMIT = 10
DONUT_SLICES = 6
CLIENT_ROWS = 10


def spider_ranking(spider_minute: DataFrame, sites: int | DataFrame, period: Period) -> DataFrame:
    """Crawlers by requests, with their share of the site's crawler traffic."""
    totals = (
        within(of_sites(spider_minute, sites), "minute_ts", period.start, period.end)
        .groupBy("site_id", "spider")
        .agg(
            F.sum("requests").alias("requests"),
            F.sum("body_bytes").alias("body_bytes"),
            F.sum("errors").alias("errors"),
            F.max("minute_ts").alias("last_seen"),
        )
    )
    # at most one row per crawler rule and site reaches the window
    site_total = F.sum("requests").over(Window.partitionBy("site_id"))
    return totals.withColumns(
        {
            "share": ratio_pct(F.col("requests"), site_total),
            "error_rate": percent("errors", "requests"),
        }
    ).orderBy("site_id", F.desc("requests"), "spider")


def spider_summary(ranking: DataFrame, sites: int | DataFrame) -> DataFrame:
    """Crawler totals per site, zeros for sites without any."""
    totals = ranking.groupBy("site_id").agg(
        F.sum("requests").alias("requests"),
        F.count("*").alias("types"),
        F.sum("body_bytes").alias("body_bytes"),
        F.sum("errors").alias("errors"),
    )
    measures = ("requests", "types", "body_bytes", "errors")
    joined = site_rows(ranking.sparkSession, sites).join(totals, "site_id", "left")
    filled = joined.withColumns({m: F.coalesce(F.col(m), F.lit(0)) for m in measures})
    return filled.withColumn("error_rate", percent("errors", "requests"))


def top_slices(ranking: DataFrame, slices: int = DONUT_SLICES) -> DataFrame:
    """The largest shares by name, the remainder as one row."""
    order = Window.partitionBy("site_id").orderBy(F.desc("requests"), "spider")
    numbered = ranking.withColumn("_n", F.row_number().over(order))
    shown = F.when(F.col("_n") <= slices, F.col("spider")).otherwise(F.lit("(other)"))
    return (
        numbered.groupBy("site_id", shown.alias("spider"), F.least("_n", F.lit(slices + 1)).alias("position"))
        .agg(F.sum("requests").alias("requests"), F.sum("share").alias("share"))
        .orderBy("site_id", "position")
    )


def client_stats(dimension_day: DataFrame, sites: int | DataFrame, period: Period) -> DataFrame:
    """Browsers, systems and devices by requests, with their share of the dimension."""
    first, last = period.days()
    totals = (
        of_sites(dimension_day, sites)
        .where(F.col("dimension").isin(*CLIENT_DIMENSIONS))
        .where(F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
        .groupBy("site_id", "dimension", F.col("value").alias("name"))
        .agg(F.sum("requests").alias("requests"), F.sum("body_bytes").alias("body_bytes"))
    )
    # at most six values per dimension and site reach the window
    whole = F.sum("requests").over(Window.partitionBy("site_id", "dimension"))
    return totals.withColumn("share", ratio_pct(F.col("requests"), whole)).orderBy(
        "site_id", "dimension", F.desc("requests"), "name"
    )


def top_clients(stats: DataFrame, rows: int = CLIENT_ROWS) -> DataFrame:
    order = Window.partitionBy("site_id", "dimension").orderBy(F.desc("requests"), "name")
    return stats.withColumn("position", F.row_number().over(order)).where(F.col("position") <= rows)


def rank(
    dimension_day: DataFrame, kind: str, sites: int | DataFrame, period: Period,
    limit: int = RANK_LIMIT, networks: DataFrame | None = None,
) -> DataFrame:
    """Top values of a dimension by requests, then by value (binary order).

    For one site this is a sorted limit. For many, the row-number filter is pushed
    below the shuffle by Spark's window group limit, so a task sends ``limit``
    rows per site at most.
    """
    first, last = period.days()
    totals = (
        of_sites(dimension_day, sites)
        .where(F.col("dimension") == kind)
        .where(F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
        .groupBy("site_id", F.col("value").alias("name"))
        .agg(
            F.sum("requests").alias("requests"),
            F.sum("body_bytes").alias("body_bytes"),
            F.sum("errors").alias("errors"),
            F.max("last_seen").alias("last_seen"),
        )
    )
    if isinstance(sites, int):
        top = totals.orderBy(F.desc("requests"), "name").limit(limit)
    else:
        order = Window.partitionBy("site_id").orderBy(F.desc("requests"), "name")
        top = (
            totals.withColumn("_n", F.row_number().over(order))
            .where(F.col("_n") <= limit)
            .drop("_n")
        )
    top = top.withColumn("error_rate", percent("errors", "requests"))
    return with_location(top, "name", networks) if kind == "ip" else top
