"""One query per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitfold.functions import clock, ip
from hitfold.functions import requests as R
from hitfold.functions.agents import with_agent
from hitfold.functions.columns import once
from hitfold.functions.sketch import exact_counts, register_counts, sketch_counts
from hitfold.operators import enrich as E
from hitfold.operators import geo, parse, retention
from hitfold.operators import rollup as U
from hitfold.operators import sites as S
from hitfold.plans import lookup, rankings, reports
from hitfold.plans import overview as O
from hitfold.plans import trend as T
from hitfold.plans.periods import DAY, Period
from hitfold.schema import DIMENSION_DAY, METRIC_MINUTE, SPIDER_MINUTE, UNIQUE_HOUR
from hitfold.session import remove_path, scratch_path
from hitfold.sources import exports
from hitfold.sources.logs import stream_messages
from hitfold.store import Store
from hitfold.streaming import live
from suite.access import (
    OPTIONS, access, later_half, networks, registry, requests, site_ids, table, whole_period,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def text_day(df: DataFrame) -> DataFrame:
    return df.withColumn("day", F.col("day").cast("string"))


def values_of(spark, folder) -> DataFrame:
    return U.unique_values(requests(spark, folder), OPTIONS)


def close_to(estimate: str, exact: str):
    """Within the 8 % a sketch of 1024 registers is held to, or one."""
    gap = F.abs(F.col(estimate) - F.col(exact))
    return gap <= F.greatest(F.lit(1.0), F.col(exact) * 0.08)


# -- classification and scalar functions ---------------------------------------------

@query
def q00_classified_requests(spark, folder):
    return requests(spark, folder).select(
        "id", "path", R.path_suffix("path").alias("suffix"), "spider", "browser",
        "system", "device", "pv", "minute_ts", "hour_ts", F.col("day").cast("string").alias("day"),
        R.error_in_range(F.col("status")).alias("failed"),
        R.is_excluded(F.col("path"), ("/api/signup",)).alias("excluded"),
    )


@query
def q00_agents_in_text(spark, folder):
    """Client rules on free text: every whole document stands in for a user agent."""
    return with_agent(table(spark, folder, "documents"), "text").groupBy(
        "spider", "browser", "system", "device"
    ).agg(F.count("*").alias("documents"))


@query
def q00_visitor_hashes(spark, folder):
    return access(spark, folder).select(
        "id",
        R.visitor_hash(F.col("remote_addr"), F.col("user_agent"), OPTIONS.salt).alias("visitor"),
        R.ip_hash(F.col("remote_addr"), OPTIONS.salt).alias("address"),
    )


# -- rollups -------------------------------------------------------------------------

@query
def q01_minute_metrics(spark, folder):
    return U.metric_minute(requests(spark, folder))


@query
def q02_spider_minute(spark, folder):
    return U.spider_minute(requests(spark, folder))


@query
def q03_dimension_day(spark, folder):
    return text_day(U.dimension_day(requests(spark, folder)))


@query
def q03_dimensions_from_cube(spark, folder):
    return text_day(U.clients_from_cube(U.traffic_cube(requests(spark, folder))))


@query
def q03_additive_upsert(spark, folder):
    """Posted and other requests as two batches; the second is added to the first."""
    rows, posted = requests(spark, folder), F.col("method") == "POST"
    first, second = (U.metric_minute(rows.where(part)) for part in (posted, ~posted))
    return U.add(first, second, METRIC_MINUTE)


# -- overview, trend -----------------------------------------------------------------

@query
def q04_overview(spark, folder):
    return O.overview(
        U.metric_partials(requests(spark, folder)), values_of(spark, folder),
        site_ids(spark, folder), whole_period(spark, folder),
    )


def _trend(spark, folder, period: Period, exact: bool = True):
    return T.trend(
        U.metric_partials(requests(spark, folder)), values_of(spark, folder),
        site_ids(spark, folder), period,
    )


@query
def q05_trend_dense(spark, folder):
    return _trend(spark, folder, whole_period(spark, folder))


@query
def q05_trend_daily(spark, folder):
    return _trend(spark, folder, whole_period(spark, folder, DAY))


@query
def q05_trend_series(spark, folder):
    period = whole_period(spark, folder, DAY)
    rows = T._dense_sums(
        U.metric_partials(requests(spark, folder)), site_ids(spark, folder), period,
        ("requests", "body_bytes"),
    )
    return T.with_series(rows, period)


# -- crawlers, clients, ranks --------------------------------------------------------

def _spiders(spark, folder):
    return rankings.spider_ranking(
        U.spider_partials(requests(spark, folder)), site_ids(spark, folder),
        whole_period(spark, folder),
    )


@query
def q06_spider_report(spark, folder):
    return _spiders(spark, folder)


@query
def q06_spider_summary(spark, folder):
    return rankings.spider_summary(_spiders(spark, folder), site_ids(spark, folder))


@query
def q06_spider_trend(spark, folder):
    return T.spider_trend(
        U.spider_partials(requests(spark, folder)), site_ids(spark, folder),
        whole_period(spark, folder, DAY),
    )


@query
def q06_spider_slices(spark, folder):
    return rankings.top_slices(_spiders(spark, folder), 1).select(
        "site_id", "spider", "position", "requests"
    )


@query
def q07_rank_uri(spark, folder):
    return rankings.rank(
        U.dimension_partials(requests(spark, folder), ("uri",)), "uri",
        site_ids(spark, folder), whole_period(spark, folder),
    )


@query
def q08_rank_ip(spark, folder):
    return rankings.rank(
        U.dimension_partials(requests(spark, folder), ("ip",)), "ip",
        site_ids(spark, folder), whole_period(spark, folder), networks=networks(spark, folder),
    )


@query
def q09_clients(spark, folder):
    return rankings.client_stats(
        U.dimension_partials(requests(spark, folder), U.CLIENT_DIMENSIONS),
        site_ids(spark, folder), whole_period(spark, folder),
    )


@query
def q09_top_clients(spark, folder):
    return rankings.top_clients(q09_clients(spark, folder), 2)


# -- request search ------------------------------------------------------------------

def _details(spark, folder):
    return E.details(requests(spark, folder))


DETAIL_COLUMNS = ("id", "site_id", "timestamp", "remote_addr", "method", "uri", "status",
                  "body_bytes", "browser", "system", "device", "spider")


@query
def q10_request_search(spark, folder):
    """First page of 200 requests whose path, address or agent holds the text."""
    found = lookup.search(
        _details(spark, folder), site_ids(spark, folder), whole_period(spark, folder),
        query="ARTICLES/1",
    )
    return lookup.page(found, 1, 200).select(*DETAIL_COLUMNS, "location")


@query
def q10_error_page(spark, folder):
    found = lookup.search(
        _details(spark, folder), site_ids(spark, folder), whole_period(spark, folder),
        errors_only=True,
    )
    return lookup.page(found, 3, 100, networks(spark, folder)).select(
        *DETAIL_COLUMNS, "location", "country"
    )


@query
def q10_deep_page(spark, folder):
    """A page so deep that the minutes before it are skipped by counting."""
    found = lookup.search(
        _details(spark, folder), site_ids(spark, folder), whole_period(spark, folder)
    )
    return lookup.narrowed(found, 4321, 200).select(*DETAIL_COLUMNS)


@query
def q10_search_counts(spark, folder):
    """Matches of every filter over all details."""
    rows, sites = _details(spark, folder), site_ids(spark, folder)
    period = whole_period(spark, folder)
    filters = {
        "all": {}, "errors": {"errors_only": True}, "4xx": {"status_group": "4xx"},
        "5xx": {"status_group": "5xx"}, "wildcard": {"query": "art_cles/%7"},
    }
    counted = [
        lookup.count(lookup.search(rows, sites, period, **f)).select(
            F.lit(name).alias("filter"), "total"
        )
        for name, f in filters.items()
    ]
    result = counted[0]
    for part in counted[1:]:
        result = result.unionByName(part)
    return result


# -- sites ---------------------------------------------------------------------------

@query
def q11_site_summary(spark, folder):
    return O.summaries(
        U.metric_partials(requests(spark, folder)), values_of(spark, folder),
        site_ids(spark, folder), whole_period(spark, folder),
    )


@query
def q11_site_list(spark, folder):
    rows = O.site_list(
        registry(spark, folder), U.metric_partials(requests(spark, folder)),
        values_of(spark, folder), whole_period(spark, folder), "nation_1", "requests", True,
    )
    return rows.select("site_id", "name", "requests", "pv", "uv", "ip", "errors")


@query
def q11_sites_with_statistics(spark, folder):
    return S.with_presence(
        registry(spark, folder), U.metric_partials(requests(spark, folder))
    ).select("id", "name", "has_statistics")


# -- comparison ----------------------------------------------------------------------

@query
def q12_period_compare(spark, folder):
    return O.compare(
        U.metric_partials(requests(spark, folder)), values_of(spark, folder),
        site_ids(spark, folder), later_half(spark, folder),
    )


def _compared(spark, folder):
    period = later_half(spark, folder)
    rows, sites = U.metric_partials(requests(spark, folder)), site_ids(spark, folder)
    now, then = (
        T._dense_sums(rows, sites, p, ("requests",)) for p in (period, period.previous())
    )
    return T.compare_trend(now, then, period)


@query
def q12_trend_compare(spark, folder):
    return _compared(spark, folder)


@query
def q12_trend_summary(spark, folder):
    return T.summarize(_compared(spark, folder))


# -- parsing -------------------------------------------------------------------------

def log_lines(rows: DataFrame) -> DataFrame:
    """Requests printed in the combined log form."""
    stamp = F.date_format(clock.epoch_ntz("timestamp"), "dd/MMM/yyyy:HH:mm:ss")
    return rows.select(
        "id", "site_id",
        F.concat(
            F.col("remote_addr"), F.lit(" - - ["), stamp, F.lit(' +0000] "'), F.col("method"),
            F.lit(" "), F.col("uri"), F.lit(" "), F.col("protocol"), F.lit('" '),
            F.col("status").cast("string"), F.lit(" "), F.col("body_bytes").cast("string"),
            F.lit(' "'), F.col("referer"), F.lit('" "'), F.col("user_agent"), F.lit('"'),
        ).alias("value"),
    )


@query
def q13_parse_roundtrip(spark, folder):
    return parse.parse_lines(log_lines(access(spark, folder))).drop("host", "cookie")


@query
def q13_parse_accounting(spark, folder):
    """A few broken lines, one excluded path and a time limit: what is accepted."""
    lines = log_lines(access(spark, folder)).withColumn(
        "value",
        F.when(F.col("id") % 13 == 0, F.translate("value", "[", "(")).otherwise(F.col("value")),
    )
    since = later_half(spark, folder).start
    options = OPTIONS.with_changes(excluded_paths=("/api/signup",))
    judged = parse.judge(parse.parse_lines(lines), options, since)
    return parse.accounting(judged, ["site_id"])


@query
def q13_parse_document_lines(spark, folder):
    """Free text is no log: how many lines of all documents pass, and how many do not."""
    lines = table(spark, folder, "documents").select(
        "source", F.explode(F.split("text", "\n")).alias("value")
    )
    return parse.accounting(parse.judge(parse.parse_lines(lines), OPTIONS), ["source"])


def messages(rows: DataFrame) -> DataFrame:
    """Requests as live messages; proxied ones name their client in a header."""
    body = F.struct(
        F.concat(
            F.date_format(clock.epoch_ntz("timestamp"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")
        ).alias("time"),
        F.col("remote_addr").alias("ip"),
        F.concat(F.lit("198.51.100."), (F.col("id") % 200).cast("string"), F.lit(", 10.0.0.7"))
        .alias("x_forwarded_for"),
        "method", "uri", "protocol", "status", F.col("body_bytes").alias("bytes"), "referer",
        F.col("user_agent").alias("ua"),
    )
    return rows.select(
        "id",
        F.concat(
            F.lit("<190>Sep  1 13:40:22 wa_"), F.col("site_id").cast("string"),
            F.lit("_access: "), F.to_json(body),
        ).alias("value"),
    )


@query
def q24_parse_messages(spark, folder):
    return parse.parse_messages(messages(access(spark, folder)), OPTIONS).drop("host", "cookie")


# -- distinct counts -----------------------------------------------------------------

@query
def q14_hll_relational(spark, folder):
    values = access(spark, folder).select(
        "site_id", F.concat_ws("|", "remote_addr", "user_agent").alias("value")
    )
    return register_counts(values, ["site_id"])


@query
def q14_hll_words(spark, folder):
    """Distinct words per language, over whole texts."""
    words = table(spark, folder, "documents").select(
        "lang", F.explode(F.split("text", " ")).alias("value")
    )
    return register_counts(words, ["lang"])


@query
def q15_hll_sketch(spark, folder):
    """Hourly sketches, merged per site: the exact count, and whether the estimate is near."""
    rows = requests(spark, folder)
    sketched = sketch_counts(U.unique_hll_hour(rows, OPTIONS), ["site_id"])
    exact = exact_counts(U.unique_values(rows, OPTIONS), ["site_id"])
    pairs = sketched.withColumnsRenamed({"uv": "_uv", "ip": "_ip"}).join(exact, "site_id")
    return pairs.select(
        "site_id", "uv", "ip",
        close_to("_uv", "uv").alias("uv_near"), close_to("_ip", "ip").alias("ip_near"),
    )


@query
def q15_exact_daily_uniques(spark, folder):
    return text_day(O.unique_days(values_of(spark, folder)))


# -- places --------------------------------------------------------------------------

@query
def q16_geo_range_join(spark, folder):
    return geo.locate(access(spark, folder), networks(spark, folder))


# -- retention, keeping details ------------------------------------------------------

@query
def q17_retention(spark, folder):
    period = whole_period(spark, folder)
    limits = OPTIONS.cutoffs(period.end)
    kept = retention.retained_details(_details(spark, folder), **limits)
    return kept.select("id", "site_id", "timestamp", "status")


@query
def q17_retention_days(spark, folder):
    period = later_half(spark, folder)
    return text_day(
        retention.retained_days(U.dimension_day(requests(spark, folder)), period.days()[0])
    )


@query
def q17_detail_keep(spark, folder):
    recent, whole = later_half(spark, folder), whole_period(spark, folder)
    kept = E.keep_details(requests(spark, folder), recent.start, whole.start + DAY)
    return E.details(kept).select(*DETAIL_COLUMNS)


# -- merging sites, migration --------------------------------------------------------

def _mapping(spark, folder):
    return S.merge_map(registry(spark, folder))


@query
def q18_site_merge(spark, folder):
    rows = U.metric_partials(requests(spark, folder))
    return S.merge_rollup(rows, _mapping(spark, folder), METRIC_MINUTE)


@query
def q18_site_merge_spiders(spark, folder):
    rows = U.spider_partials(requests(spark, folder))
    return S.merge_rollup(rows, _mapping(spark, folder), SPIDER_MINUTE)


@query
def q18_site_merge_dimensions(spark, folder):
    rows = U.dimension_partials(requests(spark, folder))
    return text_day(S.merge_rollup(rows, _mapping(spark, folder), DIMENSION_DAY))


@query
def q18_site_merge_details(spark, folder):
    moved = S.merge_details(_details(spark, folder), _mapping(spark, folder))
    return moved.select("id", "site_id", "timestamp")


@query
def q18_site_merge_sketches(spark, folder):
    """Visitors per canonical site: exact, and whether the united sketches are near."""
    rows, mapping = requests(spark, folder), _mapping(spark, folder)
    united = S.merge_sketches(U.unique_hll_hour(rows, OPTIONS), mapping)
    moved = S._canonical(U.unique_values(rows, OPTIONS), mapping)
    pairs = sketch_counts(united, ["site_id"]).withColumnsRenamed({"uv": "_uv", "ip": "_ip"}).join(
        exact_counts(moved, ["site_id"]), "site_id"
    )
    return pairs.select(
        "site_id", "uv", "ip",
        close_to("_uv", "uv").alias("uv_near"), close_to("_ip", "ip").alias("ip_near"),
    )


def legacy(spark, folder):
    """Exact first-seen rows as older stores kept them."""
    rows = requests(spark, folder)
    first = F.min("minute_ts").alias("first_minute")
    visitor = R.visitor_hash(F.col("remote_addr"), F.col("user_agent"), OPTIONS.salt)
    address = R.ip_hash(F.col("remote_addr"), OPTIONS.salt)
    return (
        rows.groupBy("site_id", "day", visitor.alias("visitor_hash")).agg(first),
        rows.groupBy("site_id", "day", address.alias("ip_hash")).agg(first),
    )


@query
def q18_site_merge_exact(spark, folder):
    """Both exact tables with their measure: the canonical site's row, else that of the lowest duplicate."""
    visitors, addresses = legacy(spark, folder)
    keys = ["site_id", "day", "kind", "value"]
    rows = visitors.select("site_id", "day", F.lit("uv").alias("kind"), F.col("visitor_hash").alias("value"), "first_minute").unionByName(
        addresses.select("site_id", "day", F.lit("ip").alias("kind"), F.col("ip_hash").alias("value"), "first_minute")
    )
    return text_day(S.merge_exact(rows, _mapping(spark, folder), keys))


@query
def q19_migrate_exact(spark, folder):
    visitors, addresses = legacy(spark, folder)
    sketches = U.migrate_exact(visitors, addresses)
    exact = (
        U.exact_rows_to_values(visitors, addresses)
        .groupBy(*UNIQUE_HOUR.keys)
        .agg(F.count_distinct("value").alias("n"))
    )
    joined = sketches.select(
        *UNIQUE_HOUR.keys, F.hll_sketch_estimate("sketch").alias("_n")
    ).join(exact, list(UNIQUE_HOUR.keys))
    return joined.select(*UNIQUE_HOUR.keys, "n", close_to("_n", "n").alias("near"))


@query
def q19_rebuild_dimensions(spark, folder):
    """Day rows lost for addresses come back from the details; the others are untouched."""
    rows = requests(spark, folder)
    existing = U.dimension_day(rows, ("uri", "browser", "system", "device"))
    return text_day(U.rebuild_dimensions(existing, E.details(rows)))


# -- addresses -----------------------------------------------------------------------

@query
def q20_client_ip(spark, folder):
    rows = access(spark, folder)
    n = F.col("id") % 200
    last = lambda prefix: F.concat(F.lit(prefix), n.cast("string"))
    rows = rows.withColumns({
        "cf_connecting_ip": F.when(F.col("id") % 7 == 0, last("9.8.7.")).otherwise(F.lit("-")),
        "x_forwarded_for": F.when(F.col("id") % 5 == 0, F.lit("10.1.1.1, 10.0.0.7"))
        .when(F.col("id") % 5 == 1, F.lit(""))
        .otherwise(F.concat(F.lit("bad, "), last("198.51.100."), F.lit(":8080, 10.0.0.7"))),
    })
    fields = {c: c for c in ("remote_addr", "cf_connecting_ip", "x_forwarded_for")}
    trusted = OPTIONS.trusted_proxies
    return once(rows, peer=F.expr(ip.peer_address(fields))).select(
        "id", F.expr(ip.client_behind("peer", fields, trusted)).alias("client"),
        F.expr(ip.in_networks("peer", trusted)).alias("trusted"),
    )


@query
def q20_address_class(spark, folder):
    """Class of addresses spread over the whole IPv4 space, one per order."""
    key = F.col("o_orderkey")
    number = F.pmod(key * F.lit(2654435761), F.lit(2**32))
    rows = table(spark, folder, "orders").select("o_orderkey", number.cast("bigint").alias("n"))
    return rows.select("o_orderkey", F.expr(ip.v4_text("n")).alias("address")).select(
        "o_orderkey", "address", F.expr(ip.address_class("address")).alias("class")
    )


@query
def q21_url_path(spark, folder):
    rows = table(spark, folder, "pages").withColumn("path", R.request_path("url"))
    return rows.select("page_id", "path", R.path_suffix("path").alias("suffix"))


# -- export --------------------------------------------------------------------------

@query
def q22_csv_guard(spark, folder):
    """Whole texts, some behind a character a spreadsheet would act on."""
    marks = F.element_at(F.array(*[F.lit(m) for m in ("=", "+", "-", "@", "", "a=")]),
                         (F.col("doc_id") % 6 + 1).cast("int"))
    return exports.guarded(
        table(spark, folder, "documents").select("doc_id", F.concat(marks, "text").alias("text"))
    )


@query
def q22_request_export(spark, folder):
    rows = exports.request_rows(
        _details(spark, folder),
        headings=("time", "ip", "method", "uri", "status", "bytes", "browser", "system",
                  "device", "spider"),
    )
    return rows


@query
def q22_csv_written(spark, folder):
    """The export written as CSV and read back."""
    path = scratch_path(spark, "csv")
    rows = q22_request_export(spark, folder)
    exports.write_csv(rows, path, quote_all=True)
    return spark.read.schema(rows.schema).csv(path, header=True, escape='"').na.fill("")


# -- streams and the store -----------------------------------------------------------

@query
def q23_stream_equals_batch(spark, folder):
    """All requests as live messages in many files, folded by a stream in several triggers."""
    feed, checkpoint = scratch_path(spark, "feed"), scratch_path(spark, "checkpoint")
    stream_options = OPTIONS.with_changes(trusted_proxies=())
    messages(access(spark, folder)).select("value").repartition(4).write.text(feed)
    store = Store(spark, scratch_path(spark, "store"), stream_options).create()
    sites = access(spark, folder).select("site_id").distinct().select(
        F.col("site_id").alias("id"), F.col("site_id").alias("panel_site_id")
    )
    running = live.start_live(
        stream_messages(spark, feed, files_per_trigger=2), store, lambda: sites, checkpoint,
        available_now=True,
    )
    running.awaitTermination()
    return store.merged("metric_minute")


@query
def q25_route_messages(spark, folder):
    """Messages of unknown sites are rejected, those of a site being loaded wait."""
    rows = access(spark, folder).withColumn("panel_site_id", F.col("site_id")).drop("site_id")
    sites = registry(spark, folder)
    busy = sites.where(F.col("name") == "NATION_2").select(F.col("id").alias("site_id"))
    options = OPTIONS.with_changes(excluded_paths=("/api/signup",))
    known = sites.withColumn("panel_site_id", F.col("id")).where(F.col("name") != "NATION_4")
    counts = live.verdict_counts(live.route(rows, known, options, busy))
    return counts.withColumn("site_id", F.coalesce("site_id", F.lit(0)))


@query
def q26_store_history(spark, folder):
    """Two batches in the store, one of them written twice, then compacted."""
    store = Store(spark, scratch_path(spark, "store"), OPTIONS).create()
    rows = access(spark, folder).withColumns(
        {"verdict": F.lit("accepted"), "file_path": F.lit("log")}
    )
    posted = F.col("method") == "POST"
    for name, part in (("posted", posted), ("other", ~posted), ("other", ~posted)):
        store.ingest(name, rows.where(part))
    store.compact()
    return text_day(store.merged("dimension_day"))


# -- the read path over stored rollups and sketches ------------------------------------

def _stored(spark, folder) -> dict[str, DataFrame]:
    """All requests ingested once: the tables that the read API works on."""
    store = Store(spark, scratch_path(spark, "store"), OPTIONS).create()
    store.ingest("all", access(spark, folder).withColumns({"verdict": F.lit("accepted"), "file_path": F.lit("log")}))
    return store.tables()


def _near(spark, folder, make, keys: list[str]) -> DataFrame:
    """``make(metric, uniques)`` over the store; its estimates as whether they are near the exact counts."""
    tables = _stored(spark, folder)
    estimated = make(tables["metric_minute"], tables["unique_hll_hour"])
    exact = make(U.metric_partials(requests(spark, folder)), values_of(spark, folder)).select(
        *keys, F.col("uv").alias("_uv"), F.col("ip").alias("_ip")
    )
    flags = {"uv_near": close_to("uv", "_uv"), "ip_near": close_to("ip", "_ip")}
    return estimated.join(exact, keys).withColumns(flags).drop("uv", "ip", "_uv", "_ip")


@query
def q33_stored_overview(spark, folder):
    sites, period = site_ids(spark, folder), whole_period(spark, folder)
    return _near(spark, folder, lambda m, u: O.overview(m, u, sites, period), ["site_id"])


@query
def q33_stored_summaries(spark, folder):
    sites, period = site_ids(spark, folder), whole_period(spark, folder)
    return _near(spark, folder, lambda m, u: O.summaries(m, u, sites, period), ["site_id"])


@query
def q33_stored_trend(spark, folder):
    sites, period = site_ids(spark, folder), whole_period(spark, folder)
    return _near(spark, folder, lambda m, u: T.trend(m, u, sites, period), ["site_id", "timestamp"])


@query
def q33_dashboard_summary(spark, folder):
    """What the dashboard says of one site's trend against the period before."""
    return reports.dashboard(_stored(spark, folder), 1, later_half(spark, folder))["trend_summary"]


# -- files ---------------------------------------------------------------------------

def _rotate(spark, folder: str, rows: DataFrame, compress: bool) -> None:
    """What a rotation does: every file of a site moves up one number, and the site's new lines take number 1."""
    system = spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    path = spark._jvm.org.apache.hadoop.fs.Path
    system.mkdirs(path(folder))
    old = sorted((s.getPath().getName() for s in system.listStatus(path(folder))), key=lambda n: -int(n.split(".")[2]))
    for name in old:
        site, _, number, *rest = name.split(".")
        system.rename(path(f"{folder}/{name}"), path(".".join([f"{folder}/{site}", "log", str(int(number) + 1), *rest])))
    fresh = scratch_path(spark, "lines")
    by_site = log_lines(rows).select("value", "site_id").repartition("site_id")
    by_site.write.partitionBy("site_id").option("compression", "gzip" if compress else "none").text(fresh)
    for part in system.listStatus(path(fresh)):
        site = part.getPath().getName()
        if site.startswith("site_id="):
            found = [f.getPath() for f in system.listStatus(part.getPath()) if f.getPath().getName().startswith("part-")]
            system.rename(found[0], path(f"{folder}/site {site[8:]}.log.1{'.gz' if compress else ''}"))
    remove_path(spark, fresh)


def _file_sites(spark, folder, logs_at: str, known) -> DataFrame:
    ids = access(spark, folder).select(F.col("site_id").alias("id")).distinct().where(known)
    return ids.withColumn("log_path", F.concat(F.lit(f"{logs_at}/site "), F.col("id").cast("string"), F.lit(".log")))


@query
def q30_rotated_files(spark, folder):
    """All requests as rotated files, plain and gzip, that change their names between loads: each line counts once."""
    logs_at = scratch_path(spark, "logs")
    store = Store(spark, scratch_path(spark, "store"), OPTIONS).create()
    sites = _file_sites(spark, folder, logs_at, F.lit(True))
    for step in range(3):
        _rotate(spark, logs_at, access(spark, folder).where(F.col("id") % 3 == step), step == 1)
        live.load_closed(store, sites, logs_at, f"load-{step}")
    live.load_closed(store, sites, logs_at, "again")
    return store.merged("metric_minute")


@query
def q31_unknown_files(spark, folder):
    """Lines of a file that belongs to no site are counted as rejected."""
    logs_at = scratch_path(spark, "logs")
    store = Store(spark, scratch_path(spark, "store"), OPTIONS).create()
    _rotate(spark, logs_at, access(spark, folder), False)
    live.load_closed(store, _file_sites(spark, folder, logs_at, F.col("id") != 5), logs_at, "load")
    return live.ingest_progress(store)


@query
def q32_long_targets(spark, folder):
    """Targets as long as whole documents keep apart where they differ only late."""
    letters = F.regexp_replace("text", "[^A-Za-z]", "")
    texts = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("/"), letters).alias("long"))
    rows = access(spark, folder).join(texts, "id").withColumn("uri", F.col("long")).drop("long")
    days = U.dimension_day(E.enrich(rows, OPTIONS), ("uri",))
    return days.groupBy(F.md5("value").alias("target"), F.length("value").cast("bigint").alias("length")).agg(F.sum("requests").alias("requests"))


# -- registry ------------------------------------------------------------------------

def _discovered(spark, folder):
    """The registry as the panel sees it now: one site per region, moved, and two new ones."""
    region = table(spark, folder, "region")
    site = lambda panel, name: region.select(
        panel.cast("bigint").alias("panel_site_id"), name.alias("name"),
        F.lit("/srv").alias("document_root"),
        F.concat(F.lit("/logs/"), name, F.lit(".log")).alias("log_path"),
        F.lit("apache").alias("web_server"),
    )
    key, name = F.col("r_regionkey"), F.col("r_name")
    return site(key + 1, name).unionByName(site(key + 101, F.concat(F.lit("NEW "), name)))


@query
def q28_register_sites(spark, folder):
    found = S.register(registry(spark, folder), _discovered(spark, folder))
    return found["sites"].select(
        "id", "panel_site_id", "name", "log_path", "web_server", "enabled"
    )


@query
def q28_register_merges(spark, folder):
    return S.register(registry(spark, folder), _discovered(spark, folder))["merges"]


@query
def q28_retain_sites(spark, folder):
    known = registry(spark, folder).where(F.col("panel_site_id") != 2)
    return S.retain(registry(spark, folder), known).select("id", "name", "enabled")


@query
def q28_list_sites(spark, folder):
    judged = access(spark, folder).withColumn("verdict", F.lit("accepted"))
    progress = parse.accounting(judged, ["site_id"])
    return S.list_sites(registry(spark, folder), progress).select(
        "id", "name", "lines", "events", "rejected"
    )


@query
def q29_byte_sizes(spark, folder):
    return table(spark, folder, "orders").select(
        "o_orderkey", R.byte_size(F.floor(F.col("o_totalprice") * F.col("o_custkey"))).alias("size")
    )


from suite import files  # noqa: E402, F401  (its queries register themselves)
