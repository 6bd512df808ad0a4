"""Composite answers: each is a dict of lazy DataFrames over the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from hitfold.operators import sites as S
from hitfold.plans import lookup, rankings
from hitfold.plans import overview as O
from hitfold.plans import trend as T
from hitfold.plans.periods import Period, period_range
from hitfold.sources import exports

Tables = dict[str, DataFrame]


def resolve_site(registry: DataFrame, requested: int) -> int | None:
    """The requested site if it is active, else the first by name."""
    listed = S.active(registry)
    if not listed.where(listed.id == requested).isEmpty():
        return requested
    first = listed.orderBy(S.by_name(), "id").select("id").first()
    return None if first is None else first.id


def dashboard(tables: Tables, site_id: int, period: Period) -> Tables:
    """Overview and trend, each with the period before and a comparison, and a summary of the trend."""
    metric, uniques = tables["metric_minute"], tables["unique_hll_hour"]
    before = period.previous()
    current, previous = (T.trend(metric, uniques, site_id, p) for p in (period, before))
    compared = T.compare_trend(current, previous, period)
    return {
        "overview": O.overview(metric, uniques, site_id, period),
        "previous": O.overview(metric, uniques, site_id, before),
        "comparison": O.compare(metric, uniques, site_id, period),
        "trend": T.with_series(current, period),
        "previous_trend": T.with_series(previous, before),
        "trend_comparison": compared,
        "trend_summary": T.summarize(compared),
    }


def spiders(tables: Tables, site_id: int, period: Period) -> Tables:
    ranking = rankings.spider_ranking(tables["spider_minute"], site_id, period)
    return {
        "ranking": ranking,
        "summary": rankings.spider_summary(ranking, site_id),
        "top": rankings.top_slices(ranking),
        "trend": T.spider_trend(tables["spider_minute"], site_id, period),
    }


def clients(tables: Tables, site_id: int, period: Period) -> DataFrame:
    return rankings.client_stats(tables["dimension_day"], site_id, period)


def report(
    tables: Tables, site_id: int, period: Period, networks: DataFrame | None = None
) -> Tables:
    days, limit = tables["dimension_day"], rankings.REPORT_LIMIT
    metric, uniques = tables["metric_minute"], tables["unique_hll_hour"]
    return {
        "overview": O.overview(metric, uniques, site_id, period),
        "top_uri": rankings.rank(days, "uri", site_id, period, limit),
        "top_ip": rankings.rank(days, "ip", site_id, period, limit, networks),
        "trend": T.trend(metric, uniques, site_id, period),
    }


def request_page(
    tables: Tables, site_id: int, period: Period, page: int = 1, page_size: int = 50,
    errors_only: bool = False, query: str = "", status_group: str = "",
    networks: DataFrame | None = None,
) -> Tables:
    found = lookup.search(
        tables["request_detail"], site_id, period, errors_only, status_group, query
    )
    return {"items": lookup.page(found, page, page_size, networks), "total": lookup.count(found)}


def export_requests(
    tables: Tables, site_id: int, period: Period, path: str, **search
) -> None:
    """A page of requests as a CSV file set."""
    items = request_page(tables, site_id, period, **search)["items"]
    exports.write_csv(exports.request_rows(items, period.timezone), path)


def named_period(name: str, now: float, tz: str = "UTC") -> Period:
    return period_range(name, now, tz)
