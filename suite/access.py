"""The driver's tables seen as access-log data."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitfold.operators.enrich import enrich
from hitfold.options import Options
from hitfold.plans.periods import DAY, Period

OPTIONS = Options(salt="pepper", trusted_proxies=("10.0.0.0/8", "192.168.0.0/16"))

AGENTS = (
    "Mozilla/5.0 (Windows NT 10.0) Chrome/140.0 Safari/537.36 Edg/140.0",
    "Mozilla/5.0 (iPhone; CPU iPhone OS 18_0 like Mac OS X) Version/18.0 Mobile Safari/604.1",
    "Mozilla/5.0 (Linux; Android 15) Chrome/140.0 Mobile Safari/537.36",
    "Mozilla/5.0 (X11; Linux x86_64; rv:140.0) Firefox/140.0",
    "Mozilla/5.0 (compatible; Googlebot/2.1)",
    "Mozilla/5.0 (compatible; GPTBot/1.2)",
    "anthropic-ai",
    "Mozilla/5.0 (Macintosh; Intel Mac OS X 15_0) Version/18.0 Safari/605.1",
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def access(spark: SparkSession, folder: str) -> DataFrame:
    """One request per row of ``events``."""
    agents = ", ".join(f"'{agent}'" for agent in AGENTS)
    k = "get_json_object(props, '$.k')"
    return table(spark, folder, "events").selectExpr(
        "event_id AS id",
        "user_id % 5 + 1 AS site_id",
        "timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) AS timestamp",
        "concat(element_at(array('203.0.113.', '10.0.0.', '9.9.9.', '192.168.1.'), "
        "int(user_id % 4 + 1)), user_id % 250) AS remote_addr",
        "CASE WHEN event_id % 17 = 0 THEN 'HEAD' "
        "WHEN event_type IN ('signup', 'purchase') THEN 'POST' ELSE 'GET' END AS method",
        f"CASE WHEN event_type = 'click' AND event_id % 3 = 0 THEN concat('/assets/app.js?v=', {k}) "
        f"WHEN event_type = 'view' THEN concat('/articles/', {k}, '?id=', user_id) "
        f"WHEN event_type = 'error' THEN concat('/missing/', {k}, '.php') "
        "WHEN event_type = 'click' THEN '/' ELSE concat('/api/', event_type) END AS uri",
        "'HTTP/1.1' AS protocol",
        "CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 2 = 0 THEN 404 ELSE 500 END "
        "WHEN event_type = 'click' AND event_id % 11 = 0 THEN 304 ELSE 200 END AS status",
        "CAST(floor(value * 100) AS BIGINT) AS body_bytes",
        "'-' AS referer",
        f"element_at(array({agents}), int(user_id % 8 + 1)) AS user_agent",
    )


def visits(spark: SparkSession, folder: str) -> DataFrame:
    """One request per row of ``pages``: its address was fetched once, by a client and at a time of its number."""
    agents = ", ".join(f"'{agent}'" for agent in AGENTS)
    return table(spark, folder, "pages").selectExpr(
        "page_id AS id",
        "page_id % 5 + 1 AS site_id",
        "1788220800 + page_id * 7919 % 1728000 AS timestamp",
        "concat('203.0.113.', page_id * 31 % 250) AS remote_addr",
        "CASE WHEN page_id % 17 = 0 THEN 'HEAD' ELSE 'GET' END AS method",
        "regexp_replace(url, '^[a-z]+://[^/]*', '') AS uri",
        "'HTTP/1.1' AS protocol",
        "CASE WHEN page_id % 13 = 0 THEN 404 WHEN page_id % 29 = 0 THEN 500 ELSE 200 END AS status",
        "page_id * 97 % 5000 AS body_bytes",
        "'-' AS referer",
        f"element_at(array({agents}), int(page_id % 8 + 1)) AS user_agent",
    )


def requests(spark: SparkSession, folder: str) -> DataFrame:
    return enrich(access(spark, folder), OPTIONS)


def registry(spark: SparkSession, folder: str) -> DataFrame:
    """Every nation as a site; nations of one region stand for copies of one panel site."""
    c = F.col
    return table(spark, folder, "nation").select(
        (c("n_nationkey") + 1).cast("bigint").alias("id"),
        (c("n_regionkey") + 1).cast("bigint").alias("panel_site_id"),
        c("n_name").alias("name"),
        F.concat(F.lit("/www/"), "n_name").alias("document_root"),
        F.concat(F.lit("/logs/"), "n_name", F.lit(".log")).alias("log_path"),
        F.lit("nginx").alias("web_server"),
        F.lit(True).alias("enabled"),
        F.lit(True).alias("user_enabled"),
    )


def site_ids(spark: SparkSession, folder: str) -> DataFrame:
    return registry(spark, folder).select(F.col("id").alias("site_id"))


def networks(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks of eight addresses per nation, of 64 per region, and two wide ones."""
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    named = nation.join(region, nation.n_regionkey == region.r_regionkey)
    base = 9 * 2**24 + 9 * 2**16 + 9 * 2**8

    def block(rows: DataFrame, start, size: int, country, area, city) -> DataFrame:
        return rows.select(
            start.cast("bigint").alias("start"), (start + size - 1).cast("bigint").alias("end"),
            country.alias("country"), area.alias("region"), city.alias("city"),
        )

    by_nation = block(
        named, F.lit(base) + F.col("n_nationkey") * 8, 8,
        F.col("r_name"), F.col("n_name"), F.col("n_name"),
    )
    by_region = block(
        region, F.lit(base) + F.col("r_regionkey") * 64, 64,
        F.col("r_name"), F.lit("area"), F.lit(""),
    )
    wide = region.agg(F.max("r_name").alias("r"))
    return by_nation.unionByName(by_region).unionByName(
        block(wide, F.lit(9 * 2**24), 2**24, F.col("r"), F.lit(""), F.lit(""))
    )


@lru_cache(maxsize=16)
def _observed(app_id: str, folder: str) -> tuple[int, int]:
    spark = SparkSession.getActiveSession()
    low, high = access(spark, folder).agg(F.min("timestamp"), F.max("timestamp")).first()
    return low - low % DAY, high - high % DAY + DAY


def whole_period(spark: SparkSession, folder: str, bucket: int = 3600) -> Period:
    """Whole UTC days from the first to the last request (one row read by the driver)."""
    start, end = _observed(spark.sparkContext.applicationId, folder)
    return Period(start, end, bucket)


def later_half(spark: SparkSession, folder: str, bucket: int = 3600) -> Period:
    """The later half of the days; with the period before it, all rows are covered."""
    whole = whole_period(spark, folder, bucket)
    days = (whole.end - whole.start) // DAY
    return Period(whole.end - (days + 1) // 2 * DAY, whole.end, bucket)
