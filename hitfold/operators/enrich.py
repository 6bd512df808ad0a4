"""Events to classified events: everything the rollups and details need, per row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitfold.functions import clock
from hitfold.functions import requests as R
from hitfold.functions.agents import with_agent
from hitfold.functions.columns import flag
from hitfold.options import Options


def enrich(events: DataFrame, options: Options) -> DataFrame:
    """Add path, client classes, page-view flag and time keys to accepted events."""
    column = F.col
    classified = with_agent(
        events.withColumns(
            {
                "path": R.request_path("uri"),
                "body_bytes": F.greatest(
                    F.lit(0).cast("bigint"), F.coalesce(column("body_bytes"), F.lit(0))
                ),
            }
        )
    )
    return classified.withColumns(
        {
            "pv": flag(R.is_page_view(options.static_extensions, "path")),
            "minute_ts": clock.minute("timestamp"),
            "hour_ts": clock.hour("timestamp"),
            "day": clock.local_day("timestamp", options.timezone),
        }
    )


def details(enriched: DataFrame) -> DataFrame:
    """Stored request details: the target is its path, texts are whole, no crawler is ''."""
    text = lambda source, name: F.coalesce(F.col(source), F.lit("")).alias(name)
    ident = ["id"] if "id" in enriched.columns else []
    return enriched.select(
        *ident,
        "site_id",
        "timestamp",
        text("remote_addr", "remote_addr"),
        text("method", "method"),
        text("path", "uri"),
        "status",
        "body_bytes",
        text("referer", "referer"),
        text("user_agent", "user_agent"),
        "browser",
        "system",
        "device",
        F.coalesce("spider", F.lit("")).alias("spider"),
        "day",
    )


def keep_details(enriched: DataFrame, detail_since: int = 0, error_since: int = 0) -> DataFrame:
    """Rows worth keeping in full: recent ones, and failed ones for longer (0 = always)."""
    recent = F.lit(True) if not detail_since else F.col("timestamp") >= detail_since
    failed = R.error_in_range(F.col("status"))
    if error_since:
        failed = failed & (F.col("timestamp") >= error_since)
    return enriched.where(recent | failed)
