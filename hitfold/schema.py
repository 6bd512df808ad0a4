"""Row types and the merge rule of every rollup."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

EVENT = T.StructType(
    [
        T.StructField("timestamp", T.LongType()),
        T.StructField("remote_addr", T.StringType()),
        T.StructField("method", T.StringType()),
        T.StructField("uri", T.StringType()),
        T.StructField("protocol", T.StringType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("body_bytes", T.LongType()),
        T.StructField("referer", T.StringType()),
        T.StructField("user_agent", T.StringType()),
        T.StructField("host", T.StringType()),
        T.StructField("cookie", T.StringType()),
    ]
)
EVENT_FIELDS = tuple(EVENT.fieldNames())

NETWORK = "start BIGINT, end BIGINT, country STRING, region STRING, city STRING"

SITE = (
    "id BIGINT, panel_site_id BIGINT, name STRING, document_root STRING, "
    "log_path STRING, web_server STRING, enabled BOOLEAN, user_enabled BOOLEAN"
)

DETAIL_FIELDS = (
    "site_id", "timestamp", "remote_addr", "method", "uri", "status", "body_bytes",
    "referer", "user_agent", "browser", "system", "device", "spider",
)


@dataclass(frozen=True)
class Rollup:
    """A table of mergeable partial rows: what identifies a row, how measures merge."""

    name: str
    keys: tuple[str, ...]
    sums: tuple[str, ...] = ()
    maxes: tuple[str, ...] = ()
    sketches: tuple[str, ...] = ()

    @property
    def columns(self) -> tuple[str, ...]:
        return self.keys + self.sums + self.maxes + self.sketches


METRIC_MINUTE = Rollup(
    "metric_minute",
    ("site_id", "minute_ts"),
    sums=("requests", "pv", "body_bytes", "errors", "bot_requests"),
)
SPIDER_MINUTE = Rollup(
    "spider_minute",
    ("site_id", "minute_ts", "spider"),
    sums=("requests", "body_bytes", "errors"),
)
DIMENSION_DAY = Rollup(
    "dimension_day",
    ("site_id", "day", "dimension", "value"),
    sums=("requests", "body_bytes", "errors"),
    maxes=("last_seen",),
)
UNIQUE_HOUR = Rollup(
    "unique_hll_hour",
    ("site_id", "hour_ts", "kind"),
    sketches=("sketch",),
)
ROLLUPS = {r.name: r for r in (METRIC_MINUTE, SPIDER_MINUTE, DIMENSION_DAY, UNIQUE_HOUR)}
