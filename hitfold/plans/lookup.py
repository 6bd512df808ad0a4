"""Request search: filters, counts and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hitfold.functions import clock
from hitfold.functions import requests as R
from hitfold.operators.geo import with_location
from hitfold.options import whole_number
from hitfold.plans.periods import Period, of_sites, within


def _needle(text: str) -> tuple[str, str]:
    """LIKE pattern and an escape character that the text does not hold: every
    ``%`` and ``_`` stays a wildcard."""
    pattern = f"%{text}%"
    escape = next(c for c in map(chr, range(33, 0xD800)) if c not in pattern and c not in "%_'")
    return pattern, escape


def search(
    details: DataFrame, sites: int | DataFrame, period: Period,
    errors_only: bool = False, status_group: str = "", query: str = "",
) -> DataFrame:
    """Details that match; text is looked for in path, address and user agent."""
    found = within(of_sites(details, sites), "timestamp", period.start, period.end)
    status = F.col("status")
    if errors_only:
        found = found.where(R.error_open(status))
    if status_group == "4xx":
        found = found.where((status >= 400) & (status < 500))
    elif status_group == "5xx":
        found = found.where(R.server_error(status))
    if query:
        pattern, escape = _needle(query)
        like = lambda c: F.expr(
            f"{c} ilike :p escape '{_sql_char(escape)}'".replace(":p", _sql_text(pattern))
        )
        found = found.where(like("uri") | like("remote_addr") | like("user_agent"))
    return found


def _sql_char(char: str) -> str:
    return "\\\\" if char == "\\" else char


def _sql_text(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def count(found: DataFrame) -> DataFrame:
    return found.agg(F.count("*").alias("total"))


def page(
    found: DataFrame, number: int = 1, size: int = 50, networks: DataFrame | None = None,
    after: tuple[int, str] | None = None,
) -> DataFrame:
    """One page, newest first, ties by id.

    ``after`` is the (timestamp, id) of a row: the pages are counted from the row behind it, so the next page costs what the first does, however deep it lies.
    A page by number is narrowed to the seconds that hold it, so that no task sorts or keeps the rows before
    them; the counts are subqueries of the same plan, and no job runs before the page is asked for.
    """
    whole_number("page number", number, 1)
    whole_number("page size", size, 1)
    if after is not None:
        time, last = F.col("timestamp"), F.lit(after[1])
        found = found.where((time < after[0]) | (time == after[0]) & (F.col("id") > last))
    rows = narrowed(found, (number - 1) * size, size) if number > 1 else found
    rows = rows.orderBy(F.desc("timestamp"), "id").limit(size)
    return with_location(rows, "remote_addr", networks).orderBy(F.desc("timestamp"), "id")


def seek(rows: DataFrame) -> DataFrame:
    """(timestamp, id) of the last row of a page: what ``after`` takes for the next one."""
    return rows.orderBy("timestamp", F.desc("id")).select("timestamp", "id").limit(1)


def _holding(found: DataFrame, width: int, offset: Column, size: int) -> dict[str, Column]:
    """The buckets of ``width`` seconds that hold rows ``offset`` to ``offset + size``: low, end and the rows before, as subqueries."""
    starts = found.groupBy(clock.bucket("timestamp", width).alias("b")).agg(F.count("*").alias("n"))
    newest = Window.orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, 0)
    counted = starts.withColumn("upto", F.sum("n").over(newest)).withColumn("before", F.col("upto") - F.col("n"))
    hit = counted.where((F.col("upto") > offset) & (F.col("before") < offset + size)).agg(
        F.struct(F.min("b").alias("low"), (F.max("b") + width).alias("end"), F.coalesce(F.min("before"), F.lit(0)).alias("before")).alias("hit")
    )
    value = hit.scalar()
    return {name: value[name] for name in ("low", "end", "before")}


def narrowed(found: DataFrame, offset: int, size: int) -> DataFrame:
    """Rows ``offset`` to ``offset + size`` in page order.

    Rows are counted per hour, then per second inside the hours that matter, so the windows stay small (hours of the
    range, seconds of few hours); numbers are given only within the seconds that hold the page.
    """
    start = F.lit(offset).cast("bigint")
    for width in (3600, 1):
        hit = _holding(found, width, start, size)
        found = found.where((F.col("timestamp") >= hit["low"]) & (F.col("timestamp") < hit["end"]))
        start = start - hit["before"]
    place = F.row_number().over(Window.orderBy(F.desc("timestamp"), "id")).alias("_place")
    return found.select("*", place).where((F.col("_place") > start) & (F.col("_place") <= start + size)).drop("_place")
