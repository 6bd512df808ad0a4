"""The read API on small data."""

import ipaddress

import pytest
from pyspark.sql import functions as F

from hitfold.functions.sketch import exact_counts
from hitfold.operators import geo
from hitfold.plans import lookup, periods, rankings, reports
from hitfold.plans import overview as O
from hitfold.plans import trend as T
from hitfold.plans.periods import Period

METRIC = "site_id bigint, minute_ts bigint, requests bigint, pv bigint, body_bytes bigint, errors bigint, bot_requests bigint"
UNIQUE = "site_id bigint, hour_ts bigint, kind string, value string"
DAYS = "site_id bigint, day date, dimension string, value string, requests bigint, body_bytes bigint, errors bigint, last_seen bigint"


def test_periods():
    now = 1788400000.5  # 2026-09-03 01:46:40 UTC
    today = periods.period_range("today", now)
    assert (today.start, today.end, today.bucket) == (1788393600, 1788400001, 3600)
    past = periods.period_range("yesterday", now)
    assert (past.start, past.end) == (1788307200, 1788393601) and past.days() == ("2026-09-02", "2026-09-03")
    assert periods.period_range("yesterday", now, exact=True).days() == ("2026-09-02", "2026-09-02")
    week = periods.period_range("7d", now, "Asia/Shanghai")
    assert (week.bucket, (week.start + 8 * 3600) % 86400) == (86400, 0)
    assert periods.period_range("nonsense", now) == today
    assert today.previous() == Period(today.start - (today.end - today.start), today.start, 3600)


@pytest.fixture(scope="module")
def tables(spark):
    metric = spark.createDataFrame([
        (1, 7200, 5, 4, 50, 1, 0), (1, 7200, 1, 0, 5, 0, 1), (1, 7260, 2, 2, 20, 0, 0), (1, 14400, 9, 9, 9, 9, 9), (2, 3600, 8, 8, 8, 0, 8)], METRIC)
    values = spark.createDataFrame([(1, 3600, "uv", "x"), (1, 7200, "uv", "x"), (1, 7200, "uv", "y"), (1, 7200, "ip", "i"), (2, 0, "ip", "j")], UNIQUE)
    return metric, values


def test_overview_takes_the_last_minute_and_whole_hours(tables):
    row = O.overview(*tables, 1, Period(7230, 14400)).first()
    assert (row.requests, row.pv, row.body_bytes, row.errors) == (2, 2, 20, 0)
    assert (row.uv, row.ip, row.realtime_bytes, row.qps) == (2, 1, 20, 0.03)
    empty = O.overview(*tables, 7, Period(0, 3600)).first()
    assert tuple(empty)[1:] == (0, 0, 0, 0, 0, 0, 0, 0, 0.0)


def test_latest_minute_sums_its_partials(tables):
    row = O.overview(*tables, 1, Period(7200, 7260)).first()
    assert (row.requests, row.realtime_bytes, row.qps) == (6, 55, 0.1)


def test_summaries_fill_zeros(spark, tables):
    sites = spark.createDataFrame([(1,), (2,), (3,)], "site_id bigint")
    rows = {r.site_id: r for r in O.summaries(*tables, sites, Period(0, 10000)).collect()}
    assert (rows[1].requests, rows[1].last_seen, rows[1].error_rate) == (8, 7260, 12.5)
    assert (rows[3].requests, rows[3].last_seen, rows[3].error_rate) == (0, 0, 0.0)
    assert O.has_statistics(tables[0], 1) and not O.has_statistics(tables[0], 3)


def test_trend_is_dense_and_places_sketches_by_hour(tables):
    rows = [tuple(r)[1:] for r in T.trend(*tables, 1, Period(7230, 10900)).orderBy("timestamp").collect()]
    assert rows == [(7200, 2, 2, 20, 0, 0, 2, 1), (10800, 0, 0, 0, 0, 0, 0, 0)]
    fine = [tuple(r) for r in T.trend(*tables, 1, Period(7230, 7400, 60)).select("timestamp", "requests", "uv").orderBy("timestamp").collect()]
    assert fine == [(7200, 0, 2), (7260, 2, 0), (7320, 0, 0), (7380, 0, 0)]


def test_comparison(tables):
    period = Period(7200, 10800)
    rows = {r.metric: (r.current, r.previous, r.change_pct) for r in O.compare(*tables, 1, period).collect()}
    assert rows["requests"] == (8.0, 0.0, None) and rows["uv"] == (2.0, 1.0, 100.0)
    assert rows["realtime_bytes"] == (20.0, 0.0, None) and rows["qps"][0] == 0.03
    now, then = (T.trend(*tables, 1, p) for p in (Period(7200, 14400), Period(0, 7200)))
    both = T.compare_trend(now, then, Period(7200, 14400), "requests")
    assert [(r.position, r.current, r.previous) for r in both.orderBy("position").collect()] == [(0, 8, 0), (1, 0, 0)]
    total = T.summarize(both).first()
    assert (total.total, total.average, total.peak, total.peak_time, total.change_pct) == (8, 4.0, 8, 7200, None)


def test_seam_hour_counts_for_both_periods(spark, tables):
    values = spark.createDataFrame([(1, 3600, "uv", "a")], UNIQUE)
    rows = {r.metric: r for r in O.compare(tables[0], values, 1, Period(5400, 7200)).collect()}
    assert (rows["uv"].current, rows["uv"].previous) == (1.0, 1.0)


def days(spark, *rows):
    return spark.createDataFrame(rows, "site_id bigint, d string, dimension string, value string, requests bigint, body_bytes bigint, errors bigint, last_seen bigint").selectExpr(
        "site_id", "to_date(d) AS day", "dimension", "value", "requests", "body_bytes", "errors", "last_seen")


def test_ranks_and_clients(spark):
    table = days(spark, (1, "1970-01-01", "uri", "/b", 5, 1, 1, 10), (1, "1970-01-02", "uri", "/b", 5, 1, 0, 90000), (1, "1970-01-01", "uri", "/a", 10, 1, 0, 5),
                 (1, "1970-01-01", "uri", "/c", 1, 1, 0, 5), (1, "1970-01-05", "uri", "/z", 99, 1, 0, 5), (1, "1970-01-01", "ip", "10.0.0.1", 3, 1, 0, 5),
                 (1, "1970-01-01", "browser", "Edge", 3, 1, 0, 5), (1, "1970-01-01", "browser", "Other", 1, 1, 0, 5))
    period = Period(0, 2 * 86400)
    one = rankings.rank(table, "uri", 1, period, 2).collect()
    assert [(r.name, r.requests, r.errors, r.last_seen) for r in one] == [("/a", 10, 0, 5), ("/b", 10, 1, 90000)]
    many = rankings.rank(table, "uri", spark.createDataFrame([(1,)], "site_id bigint"), period, 2)
    assert {r.name for r in many.collect()} == {"/a", "/b"}
    assert rankings.rank(table, "ip", 1, period).first().location == "内网地址"
    assert [(r.name, r.share) for r in rankings.client_stats(table, 1, period).collect()] == [("Edge", 75.0), ("Other", 25.0)]


def test_crawler_report(spark):
    rows = spark.createDataFrame([(1, 0, "A", 3, 30, 1), (1, 60, "A", 1, 5, 0), (1, 60, "B", 4, 5, 0), (1, 0, "C", 2, 5, 2)],
                                 "site_id bigint, minute_ts bigint, spider string, requests bigint, body_bytes bigint, errors bigint")
    answers = reports.spiders({"spider_minute": rows}, 1, Period(0, 7200))
    assert [(r.spider, r.requests, r.share) for r in answers["ranking"].collect()] == [("A", 4, 40.0), ("B", 4, 40.0), ("C", 2, 20.0)]
    total = answers["summary"].first()
    assert (total.requests, total.types, total.errors, total.error_rate) == (10, 3, 3, 30.0)
    assert [r.requests for r in answers["trend"].orderBy("timestamp").collect()] == [10, 0]
    top = rankings.top_slices(answers["ranking"], 2).collect()
    assert [(r.spider, r.requests) for r in top] == [("A", 4), ("B", 4), ("(other)", 2)]


@pytest.fixture(scope="module")
def details(spark):
    n = F.col("id")
    return spark.range(3000).select(
        n.cast("string").alias("id"), F.lit(1).cast("bigint").alias("site_id"), F.floor(n / 7).alias("timestamp"),
        F.concat(F.lit("8.8.8."), (n % 200).cast("string")).alias("remote_addr"), F.lit("GET").alias("method"),
        F.concat(F.lit("/p/"), n.cast("string"), F.when(n % 10 == 0, F.lit("%_x\\y")).otherwise(F.lit(""))).alias("uri"),
        F.when(n % 3 == 0, 404).when(n % 3 == 1, 700).otherwise(200).alias("status"), F.lit(1).cast("bigint").alias("body_bytes"),
        F.lit("-").alias("referer"), F.lit("Mozilla").alias("user_agent"), F.lit("").alias("spider"))


def test_search_filters(details):
    period = Period(0, 10**6)
    n = lambda **f: lookup.count(lookup.search(details, 1, period, **f)).first().total
    assert (n(), n(errors_only=True), n(status_group="4xx"), n(status_group="5xx")) == (3000, 2000, 1000, 1000)
    assert n(query="MOZ") == 3000 and n(query="x\\y") == 300 and n(query="p/_0%") == n(query="P/_0%") > 0
    assert n(query="it's") == 0


def jobs_of(spark, build):
    """What ``build`` returns, and the jobs that ran meanwhile."""
    spark.sparkContext.setJobGroup("planning", "")
    try:
        return build(), len(spark.sparkContext.statusTracker().getJobIdsForGroup("planning"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("page,size", [(1, 10), (3, 200), (15, 200), (16, 200), (300, 10)])
def test_deep_pages_equal_plain_ones(spark, details, page, size):
    found = lookup.search(details, 1, Period(0, 10**6))
    deep, jobs = jobs_of(spark, lambda: lookup.page(found, page, size))
    everything = [r.id for r in details.orderBy(F.desc("timestamp"), "id").collect()]
    assert [r.id for r in deep.collect()] == everything[(page - 1) * size : page * size] and not jobs


def test_pages_by_seek_tokens_follow_each_other(details):
    found, after, seen = lookup.search(details, 1, Period(0, 10**6), errors_only=True), None, []
    for _ in range(4):
        items = lookup.page(found, 1, 333, after=after)
        seen += [r.id for r in items.collect()]
        after = tuple(lookup.seek(items).first())
    assert seen == [r.id for r in found.orderBy(F.desc("timestamp"), "id").limit(4 * 333).collect()]
    assert [r.id for r in lookup.page(found, 2, 10, after=after).collect()] == [r.id for r in found.orderBy(F.desc("timestamp"), "id").offset(4 * 333 + 10).limit(10).collect()]


def test_places_are_planned_without_a_job(spark):
    networks = spark.createDataFrame([("8.0.0.0/8", "A", "", "")], "network string, country string, region string, city string")
    rows = spark.createDataFrame([("8.1.1.1",), ("9.1.1.1",)], "address string")
    located, jobs = jobs_of(spark, lambda: geo.with_location(rows, "address", networks))
    assert not jobs and {r.address: r.country for r in located.collect()} == {"8.1.1.1": "A", "9.1.1.1": ""}


def test_places_match_brute_force(spark):
    nets = [("8.0.0.0/8", "A", "", ""), ("8.8.0.0/16", "A", "R", ""), ("8.8.8.0/27", "A", "R", "C"), ("8.8.8.8/32", "A", "A", "X"),
            ("9.9.9.128/25", "B", "", "B"), ("2600::/12", "V", "", ""), ("2607:f8b0::/33", "V", "W", "")]
    networks = spark.createDataFrame(nets, "network string, country string, region string, city string")
    values = ["8.8.8.8", "8.8.8.31", "8.8.8.32", "8.9.1.1", "9.9.9.127", "9.9.9.200", "10.0.0.1", "bad", "2607:f8b0::1", "2607:f8b0:8000::1", "2a00::1", "::1"]
    rows = geo.locate(spark.createDataFrame([(v,) for v in values], "remote_addr string"), networks)
    for r in rows.collect():
        try:
            a = ipaddress.ip_address(r.address)
            hits = [(ipaddress.ip_network(n).prefixlen, rest) for n, *rest in nets if a in ipaddress.ip_network(n)]
        except ValueError:
            hits = []
        best = max(hits)[1] if hits else ["", "", ""]
        assert [r.country, r.region, r.city] == best, r.address
    text = {r.address: r.location for r in rows.collect()}
    assert (text["8.8.8.8"], text["8.8.8.31"], text["10.0.0.1"], text["bad"], text["2a00::1"], text["::1"]) == (
        "A · X", "A · R · C", "内网地址", "无效地址", "未知", "本机")


def test_exact_counts(tables):
    row = exact_counts(tables[1].where("site_id = 1"), ["site_id"]).first()
    assert (row.uv, row.ip) == (2, 1)


def test_search_and_pages_take_whole_values(spark):
    long = "/" + "a" * 3000
    rows = [(1, i, f"{long}{i}", "1.1.1.1", 200, "agent " + "x" * 2000 + str(i)) for i in range(3)]
    details = spark.createDataFrame(rows, "site_id long, timestamp long, uri string, remote_addr string, status int, user_agent string")
    for query in (long + "2", "x" * 200 + "2"):
        found = lookup.search(details, 1, Period(0, 10), query=query)
        assert [r.timestamp for r in found.collect()] == [2]
    for number, size in ((0, 50), (1, 0), ("1", 50)):
        with pytest.raises(ValueError):
            lookup.page(details, number, size)
    numbered = details.withColumn("id", F.col("timestamp").cast("string"))
    assert lookup.page(numbered, 100_001, 5).count() == 0 and lookup.page(numbered, 1, 2).count() == 2
