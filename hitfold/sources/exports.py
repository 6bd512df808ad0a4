"""CSV output, safe to open in a spreadsheet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitfold.functions import clock
from hitfold.functions.requests import csv_guard

# Headings of the request export, in order.
REQUEST_HEADINGS = ("时间", "IP", "方法", "URI", "状态码", "流量", "浏览器", "系统", "设备", "蜘蛛")


def request_rows(items: DataFrame, tz: str = "UTC", headings=REQUEST_HEADINGS) -> DataFrame:
    """The ten export columns of a page of requests, all text, guarded."""
    local = clock.local_ntz("timestamp", tz)
    values = (
        F.date_format(local, "yyyy-MM-dd HH:mm:ss"),
        *[
            F.col(c)
            for c in ("remote_addr", "method", "uri", "status", "body_bytes",
                      "browser", "system", "device", "spider")
        ],
    )
    return items.select(*[csv_guard(v).alias(h) for v, h in zip(values, headings)])


def guarded(rows: DataFrame) -> DataFrame:
    """Any table as guarded text; null becomes the empty text."""
    return rows.select(
        *[csv_guard(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in rows.columns]
    )


# Columns of the report export.
REPORT_COLUMNS = ("name", "requests", "body_bytes", "errors")


def report_rows(ranked: DataFrame) -> DataFrame:
    """The ranking of a report as exported."""
    return guarded(ranked.select(*REPORT_COLUMNS))


def write_csv(rows: DataFrame, path: str, quote_all: bool = False) -> None:
    """Write with a header. Cells are quoted where needed, or all of them."""
    (
        rows.write.option("header", True)
        .option("quoteAll", quote_all)
        .option("escape", '"')
        .option("emptyValue", "")
        .csv(path)
    )
