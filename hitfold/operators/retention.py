"""Expiry of details and day rollups as predicates; physical removal is in the store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitfold.functions.requests import error_open


def retained_details(details: DataFrame, raw_before: int, error_before: int) -> DataFrame:
    """Details that survive cleanup; failed requests have their own, longer limit."""
    failed = error_open(F.col("status"))
    return details.where(
        (~failed & (F.col("timestamp") >= raw_before))
        | (failed & (F.col("timestamp") >= error_before))
    )


def retained_days(dimension_day: DataFrame, before_day: str) -> DataFrame:
    """Day rows not older than ``before_day`` (yyyy-MM-dd; empty keeps all)."""
    if not before_day:
        return dimension_day
    return dimension_day.where(F.col("day") >= F.lit(before_day).cast("date"))
