"""Folding events into mergeable rollups.

Every measure is a sum, a maximum or a sketch union, so one event is already a valid partial
row. Builders emit partial rows; ``merge`` folds any mix of partials. A hot site or key costs
nothing extra, since each task combines its rows before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitfold.functions import clock
from hitfold.functions import requests as R
from hitfold.functions.columns import flag
from hitfold.functions.sketch import sketch_of
from hitfold.options import Options
from hitfold.schema import DIMENSION_DAY, METRIC_MINUTE, SPIDER_MINUTE, UNIQUE_HOUR, Rollup


CLIENT_DIMENSIONS = ("browser", "system", "device")
DIMENSIONS = ("ip", "uri") + CLIENT_DIMENSIONS


def merge(partials: DataFrame, rollup: Rollup) -> DataFrame:
    """One row per key: sums add up, maxima win, sketches unite.

    Sketches of different precision are an error.
    """
    return partials.groupBy(*rollup.keys).agg(
        *[F.sum(c).alias(c) for c in rollup.sums],
        *[F.max(c).alias(c) for c in rollup.maxes],
        *[F.hll_union_agg(c).alias(c) for c in rollup.sketches],
    )


def add(existing: DataFrame, batch: DataFrame, rollup: Rollup) -> DataFrame:
    """Additive upsert of a batch into a rollup."""
    both = existing.select(*rollup.columns).unionByName(batch.select(*rollup.columns))
    return merge(both, rollup)


def insert_new(
    existing: DataFrame, candidates: DataFrame, keys: list[str], order: tuple[str, ...] = ()
) -> DataFrame:
    """Existing rows plus the candidates whose key is not there yet.

    Of several candidates for a key the least by ``order``, then by the other columns, is taken.
    """
    others = [c for c in (*order, *existing.columns) if c not in keys]
    fresh = (
        candidates.join(existing.select(*keys), keys, "left_anti")
        .groupBy(*keys).agg(F.min(F.struct(*dict.fromkeys(others))).alias("_row"))
    )
    columns = [F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in existing.columns]
    return existing.unionByName(fresh.select(*columns))


def one() -> Column:
    return F.lit(1).cast("bigint")


# -- partial rows, one or more per event ---------------------------------------------

def metric_partials(enriched: DataFrame) -> DataFrame:
    return enriched.select(
        "site_id",
        "minute_ts",
        one().alias("requests"),
        "pv",
        "body_bytes",
        flag(R.error_in_range(F.col("status"))).alias("errors"),
        flag(F.col("is_bot")).alias("bot_requests"),
    )


def spider_partials(enriched: DataFrame) -> DataFrame:
    # the filter repeats the cheap test only, not the whole list of names
    return enriched.where("is_bot").select(
        "site_id",
        "minute_ts",
        "spider",
        one().alias("requests"),
        "body_bytes",
        flag(R.error_in_range(F.col("status"))).alias("errors"),
    )


def dimension_partials(
    enriched: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS
) -> DataFrame:
    """One row per event and dimension; ``day`` stays a DATE."""
    sources = {
        "ip": F.col("remote_addr"),
        "uri": F.col("path"),
        **{name: F.col(name) for name in CLIENT_DIMENSIONS},
    }
    wide = enriched.select(
        "site_id",
        "day",
        F.col("body_bytes"),
        flag(R.error_open(F.col("status"))).alias("errors"),
        F.col("timestamp").alias("last_seen"),
        *[sources[name].alias(name) for name in dimensions],
    )
    long = wide.unpivot(
        ["site_id", "day", "body_bytes", "errors", "last_seen"],
        list(dimensions),
        "dimension",
        "value",
    )
    return long.select(
        "site_id", "day", "dimension", "value",
        one().alias("requests"), "body_bytes", "errors", "last_seen",
    )


def unique_values(enriched: DataFrame, options: Options) -> DataFrame:
    """Salted visitor and address hashes, one row per event and kind."""
    hashed = enriched.select(
        "site_id",
        "hour_ts",
        R.visitor_hash(F.col("remote_addr"), F.col("user_agent"), options.salt).alias("uv"),
        R.ip_hash(F.col("remote_addr"), options.salt).alias("ip"),
    )
    return hashed.unpivot(["site_id", "hour_ts"], ["uv", "ip"], "kind", "value")


# -- rollups -------------------------------------------------------------------------

def metric_minute(enriched: DataFrame) -> DataFrame:
    return merge(metric_partials(enriched), METRIC_MINUTE)


def spider_minute(enriched: DataFrame) -> DataFrame:
    return merge(spider_partials(enriched), SPIDER_MINUTE)


def dimension_day(
    enriched: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS
) -> DataFrame:
    return merge(dimension_partials(enriched, dimensions), DIMENSION_DAY)


def unique_hll_hour(enriched: DataFrame, options: Options) -> DataFrame:
    """Hourly sketches of visitors and addresses.

    The two kinds are two aggregates over the same rows, unpivoted after the fold, so
    the shuffle moves one row per task, site and hour.
    """
    folded = enriched.groupBy("site_id", "hour_ts").agg(
        sketch_of(
            R.visitor_hash(F.col("remote_addr"), F.col("user_agent"), options.salt),
            options.hll_precision,
        ).alias("uv"),
        sketch_of(R.ip_hash(F.col("remote_addr"), options.salt), options.hll_precision).alias("ip"),
    )
    return folded.unpivot(["site_id", "hour_ts"], ["uv", "ip"], "kind", "sketch")


def sketches_of_values(values: DataFrame, precision: int) -> DataFrame:
    """Hourly sketches of rows (site_id, hour_ts, kind, value)."""
    return values.groupBy(*UNIQUE_HOUR.keys).agg(sketch_of(F.col("value"), precision).alias("sketch"))


# -- one pass for many rollups -------------------------------------------------------

CUBE_KEYS = ("site_id", "minute_ts", "day", "spider", "browser", "system", "device")


def traffic_cube(enriched: DataFrame) -> DataFrame:
    """Minute totals by crawler and client class: small, and enough for three rollups."""
    return enriched.groupBy(*CUBE_KEYS).agg(
        F.count("*").alias("requests"),
        F.sum("pv").alias("pv"),
        F.sum("body_bytes").alias("body_bytes"),
        F.sum(flag(R.error_in_range(F.col("status")))).alias("errors"),
        F.sum(flag(R.error_open(F.col("status")))).alias("open_errors"),
        F.max("timestamp").alias("last_seen"),
    )


def metric_from_cube(cube: DataFrame) -> DataFrame:
    bots = F.when(F.col("spider").isNotNull(), F.col("requests")).otherwise(F.lit(0))
    return merge(cube.withColumn("bot_requests", bots), METRIC_MINUTE)


def spider_from_cube(cube: DataFrame) -> DataFrame:
    return merge(cube.where(F.col("spider").isNotNull()), SPIDER_MINUTE)


def clients_from_cube(cube: DataFrame) -> DataFrame:
    wide = cube.select(
        "site_id", "day", "requests", "body_bytes",
        F.col("open_errors").alias("errors"), "last_seen", *CLIENT_DIMENSIONS,
    )
    long = wide.unpivot(
        ["site_id", "day", "requests", "body_bytes", "errors", "last_seen"],
        list(CLIENT_DIMENSIONS), "dimension", "value",
    )
    return merge(long, DIMENSION_DAY)


# -- rebuilding and migrating --------------------------------------------------------

def dimensions_of_details(details: DataFrame) -> DataFrame:
    """Day dimensions recomputed from stored request details."""
    return dimension_day(details.withColumn("path", F.col("uri")))


def rebuild_dimensions(existing: DataFrame, details: DataFrame) -> DataFrame:
    """Day dimensions from details for every key the table lacks."""
    return insert_new(existing, dimensions_of_details(details), list(DIMENSION_DAY.keys))


def exact_rows_to_values(visitor_day: DataFrame, ip_day: DataFrame) -> DataFrame:
    """Legacy first-seen rows as (site_id, hour_ts, kind, value)."""
    tagged = lambda df, column, kind: df.select(
        "site_id",
        clock.hour("first_minute").alias("hour_ts"),
        F.lit(kind).alias("kind"),
        F.col(column).alias("value"),
    )
    return tagged(visitor_day, "visitor_hash", "uv").unionByName(tagged(ip_day, "ip_hash", "ip"))


def migrate_exact(
    visitor_day: DataFrame, ip_day: DataFrame, precision: int = 10, existing: DataFrame | None = None
) -> DataFrame:
    """Legacy exact rows as hourly sketches, united with existing sketches."""
    sketches = sketches_of_values(exact_rows_to_values(visitor_day, ip_day), precision)
    return sketches if existing is None else add(existing, sketches, UNIQUE_HOUR)
