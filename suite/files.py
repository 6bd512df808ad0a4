"""Queries over log files, streams and the store. Their requests come from ``pages``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitfold.functions import ip
from hitfold.operators import parse
from hitfold.operators import rollup as U
from hitfold.operators import sites as S
from hitfold.operators.enrich import enrich
from hitfold.plans import reports
from hitfold.plans.periods import PERIODS, Period, period_range, within
from hitfold.session import remove_path, scratch_path
from hitfold.sources import logs, registry
from hitfold.sources.follow import follow_lines
from hitfold.store import Store
from hitfold.streaming import live
from suite.access import OPTIONS, registry as nations, visits
from suite.queries import _discovered, log_lines, messages, query, text_day

SITES = 5


def _system(spark, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    system = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(path(folder))
    return system, path


def write_logs(spark, folder: str, rows: DataFrame, suffix: str = "", codec: str = "none") -> None:
    """One file per site, ``site N.log`` and the suffix, its lines in order of their ids; files of that name are replaced."""
    system, path = _system(spark, folder)
    fresh = scratch_path(spark, "lines")
    lines = log_lines(rows).repartition("site_id").sortWithinPartitions("site_id", "id").select("value", "site_id")
    lines.write.partitionBy("site_id").option("compression", codec).text(fresh)
    for part in system.listStatus(path(fresh)):
        site = part.getPath().getName()
        if site.startswith("site_id="):
            found = [f.getPath() for f in system.listStatus(part.getPath()) if f.getPath().getName().startswith("part-")]
            target = path(f"{folder}/site {site[8:]}.log{suffix}{'.gz' if codec == 'gzip' else ''}")
            system.delete(target, False)
            system.rename(found[0], target)
    remove_path(spark, fresh)


def rotate(spark, folder: str) -> None:
    """Every file of every log moves up one number."""
    system, path = _system(spark, folder)
    names = [s.getPath().getName() for s in system.listStatus(path(folder))]
    split = lambda name: (name.split(".log")[0], int((name.split(".log.")[1:] or ["0"])[0].split(".")[0]), ".gz" if name.endswith(".gz") else "")
    for log, number, end in sorted((split(n) for n in names if ".log" in n and not n.startswith(".")), key=lambda x: -x[1]):
        old = f"{folder}/{log}.log{f'.{number}' if number else ''}{end}"
        system.rename(path(old), path(f"{folder}/{log}.log.{number + 1}{end}"))


def log_sites(spark, logs_at: str, *ids: int) -> DataFrame:
    rows = [(i, f"{logs_at}/site {i}.log") for i in ids or range(1, SITES + 1)]
    return spark.createDataFrame(rows, "id bigint, log_path string")


def new_store(spark, name: str = "store") -> Store:
    return Store(spark, scratch_path(spark, name), OPTIONS).create()


@query
def q34_rotation_inside_load(spark, folder):
    """All requests in files that rotate while they are loaded, between listing and reading and between reading and committing."""
    logs_at, store = scratch_path(spark, "logs"), new_store(spark)
    part = lambda k: visits(spark, folder).where(F.col("id") % 3 == k)
    write_logs(spark, logs_at, part(0), ".1")
    later = [1, 2]

    def between() -> None:
        if later:
            rotate(spark, logs_at)
            write_logs(spark, logs_at, part(later.pop(0)), ".1")

    for step in range(3):
        live.load_closed(store, log_sites(spark, logs_at), logs_at, f"load-{step}", between=between)
    return store.merged("metric_minute")


@query
def q34_repeated_progress(spark, folder):
    """Progress after the same files were loaded three times, one of them of no site, and after that site was registered."""
    logs_at, store = scratch_path(spark, "logs"), new_store(spark)
    write_logs(spark, logs_at, visits(spark, folder), ".1")
    known = log_sites(spark, logs_at, 1, 2, 3, 4)
    for step in range(3):
        live.load_closed(store, known, logs_at, f"load-{step}")
    before = live.ingest_progress(store).withColumn("registered", F.lit(False))
    rotate(spark, logs_at)
    live.load_closed(store, known, logs_at, "moved")
    live.load_closed(store, log_sites(spark, logs_at), logs_at, "all")
    return before.unionByName(live.ingest_progress(store).withColumn("registered", F.lit(True)))


@query
def q35_followed_logs(spark, folder):
    """All requests through logs that grow, rotate and are truncated while a stream follows them."""
    logs_at, store, checkpoint = scratch_path(spark, "logs"), new_store(spark), scratch_path(spark, "checkpoint")
    _system(spark, logs_at)
    part = lambda *steps: visits(spark, folder).where((F.col("id") % 20).between(steps[0] * 4, steps[-1] * 4 + 3)).withColumn("id", F.col("id") + F.col("id") % 20 * 10_000_000_000)

    def run() -> None:
        lines = follow_lines(spark, logs_at)
        live.start_history(lines, store, log_sites(spark, logs_at), checkpoint, 0, "follow", days=None).awaitTermination()

    write_logs(spark, logs_at, part(0))
    run()
    write_logs(spark, logs_at, part(0, 1))  # more lines behind those that were read
    run()
    write_logs(spark, logs_at, part(0, 2))
    rotate(spark, logs_at)
    write_logs(spark, logs_at, part(3))
    run()
    write_logs(spark, logs_at, part(4))  # as after truncation
    run()
    return store.merged("metric_minute")


@query
def q36_sites_merged_in_store(spark, folder):
    """Requests of five sites in several batches and folds; sites 4 and 5 turn out to be site 1, site 2 is dropped."""
    store = new_store(spark)
    rows = visits(spark, folder).withColumns({"verdict": F.lit("accepted"), "file_path": F.lit("log")})
    for step in range(4):
        store.ingest(f"part-{step}", rows.where(F.col("id") % 4 == step), stage=False)
        store.fold(limit=2)
    store.merge_sites(spark.createDataFrame([(4, 1), (5, 1)], "site_id bigint, canonical_id bigint"))
    store.drop_sites(spark.createDataFrame([(2,)], "site_id bigint"))
    return store.merged("metric_minute")


@query
def q36_details_after_merge(spark, folder):
    """Request details by site after sites 4 and 5 were merged into site 1."""
    store = new_store(spark)
    rows = visits(spark, folder).withColumns({"verdict": F.lit("accepted"), "file_path": F.lit("log")})
    store.ingest("all", rows)
    store.merge_sites(spark.createDataFrame([(4, 1), (5, 1)], "site_id bigint, canonical_id bigint"))
    return store.partials("request_detail").groupBy("site_id", "status").agg(F.count("*").alias("requests"), F.sum("body_bytes").alias("body_bytes"))


def _live(spark, folder, counters: live.Counters | None = None, known: tuple[int, ...] = (1, 2, 3, 4, 5), busy: tuple[int, ...] = ()) -> Store:
    """All requests as live messages in several micro-batches, of times in no order; every second one folds the store."""
    feed = scratch_path(spark, "feed")
    messages(visits(spark, folder)).select("value").repartition(6).write.text(feed)
    store = Store(spark, scratch_path(spark, "store"), OPTIONS.with_changes(trusted_proxies=())).create()
    sites = spark.createDataFrame([(i, i) for i in known], "id bigint, panel_site_id bigint")
    waiting = spark.createDataFrame([(i,) for i in busy], "site_id bigint") if busy else None
    live.start_live(
        logs.stream_messages(spark, feed, files_per_trigger=2), store, lambda: sites, scratch_path(spark, "checkpoint"), backfilling=lambda: waiting,
        available_now=True, counters=counters, fold_every=2,
    ).awaitTermination()
    return store


@query
def q37_live_counters(spark, folder):
    """Counters that a running stream keeps, beside the statistics in the store: site 5 is unknown, site 4 is being loaded from files."""
    counters = live.Counters()
    store = _live(spark, folder, counters, (1, 2, 3, 4), (4,))
    rows = [(site, held["lines"], held["events"], held["rejected"], held["deferred"]) for site, held in counters.sites.items()]
    kept = spark.createDataFrame(rows, "site_id bigint, live_lines bigint, live_events bigint, live_rejected bigint, live_deferred bigint")
    return live.ingest_progress(store).join(kept, "site_id", "full")


@query
def q37_stream_days(spark, folder):
    """Daily dimensions of the stream, folded while it runs."""
    return text_day(_live(spark, folder).merged("dimension_day"))


@query
def q37_stream_crawlers(spark, folder):
    """Crawlers per minute of the stream."""
    return _live(spark, folder).merged("spider_minute")


@query
def q37_stream_details(spark, folder):
    """Request details of the stream; late ones are as good as others."""
    return _live(spark, folder).partials("request_detail").select("site_id", "timestamp", "remote_addr", "method", "uri", "status", "body_bytes", "browser", "system", "device")


@query
def q38_start_at_end(spark, folder):
    """A stream that starts at the end of its logs sees only lines that come later."""
    logs_at, store, checkpoint = scratch_path(spark, "logs"), new_store(spark), scratch_path(spark, "checkpoint")
    late = F.col("id") % 2
    numbered = visits(spark, folder).withColumn("id", F.col("id") + late * 10_000_000_000)
    for part in (numbered.where(late == 0), numbered):
        write_logs(spark, logs_at, part)
        lines = follow_lines(spark, logs_at, start="latest")
        live.start_history(lines, store, log_sites(spark, logs_at), checkpoint, 0, "follow", days=None).awaitTermination()
    return store.merged("metric_minute")


@query
def q38_history_files(spark, folder):
    """The current file of a log, its rotated and its compressed files, as requests."""
    logs_at = scratch_path(spark, "logs")
    rows = visits(spark, folder)
    for part, suffix, codec in ((0, "", "none"), (1, ".1", "none"), (2, ".2", "gzip")):
        write_logs(spark, logs_at, rows.where(F.col("id") % 3 == part), suffix, codec)
    found = parse.parse_lines(logs.read_history(spark, f"{logs_at}/site 3.log"))
    return found.groupBy("remote_addr", "status").agg(F.count("*").alias("requests"), F.sum("body_bytes").alias("body_bytes"))


@query
def q38_escaped_lines(spark, folder):
    """Lines whose request has one, two or three parts and whose quoted fields hold escaped characters."""
    rows = visits(spark, folder).select("id", "timestamp", "method", "uri")
    form = F.when(F.col("id") % 3 == 0, F.col("uri")).when(F.col("id") % 3 == 1, F.concat_ws(" ", "method", "uri")).otherwise(F.concat_ws(" ", "method", "uri", F.lit("HTTP/2.0")))
    stamp = F.date_format(F.timestamp_seconds("timestamp"), "dd/MMM/yyyy:HH:mm:ss")
    quoted = F.concat(F.lit(r"a\x22"), F.col("id").cast("string"), F.lit(r"\x5Cn \"b"))
    line = F.concat(F.lit("1.2.3.4 - - ["), stamp, F.lit(' +0000] "'), form, F.lit('" 200 - "'), quoted, F.lit('" "'), quoted, F.lit('"'))
    lines = rows.select("id", line.alias("value"))
    return parse.parse_lines(lines).select("id", "timestamp", "method", "uri", "protocol", "body_bytes", "referer", "user_agent")


@query
def q38_registered_sites(spark, folder):
    """Hosts of all pages as rows of a panel's registry; rows without a name or a positive id are left out."""
    hosts = spark.read.parquet(f"{folder}/pages.parquet").select(
        (F.col("page_id") - 1).alias("id"), F.when(F.col("page_id") % 7 > 0, F.concat(F.lit(" "), F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1))).alias("name"),
        F.lit("/www").alias("path"), F.when(F.col("page_id") % 2 == 0, F.lit("apache")).alias("web_server"),
        F.when(F.col("page_id") % 5 == 0, F.lit("/own/access.log")).alias("log_path"),
    )
    return registry.registered(hosts, "/logs/")


@query
def q38_orphan_logs(spark, folder):
    """Logs of hosts that no registry row names, numbered in order of their names."""
    host = F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1)
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", host.alias("host"))
    ending = F.when(F.col("page_id") % 3 == 0, F.lit(".error.log")).when(F.col("page_id") % 3 == 1, F.lit(".log")).otherwise(F.lit(".txt"))
    files = pages.select(F.concat(F.lit("file:///logs/"), "host", ending).alias("path")).distinct()
    known = pages.where("page_id % 4 = 0").select(F.concat(F.lit("/logs/"), "host", F.lit(".log")).alias("log_path")).distinct()
    return registry.orphans(files, known)


def v6_texts(spark, folder: str) -> DataFrame:
    """An address in some textual form of IPv6 for every page."""
    digits = "lower(hex(page_id % 65535 + 1))"
    return spark.read.parquet(f"{folder}/pages.parquet").selectExpr("page_id AS id", f"""
        CASE page_id % 7
          WHEN 0 THEN concat('2001:0DB8:0:0:0:0:0:', upper(lpad({digits}, 4, '0')))
          WHEN 1 THEN concat('2600:1f18::', {digits})
          WHEN 2 THEN concat('::ffff:203.0.113.', page_id % 250)
          WHEN 3 THEN concat('fe80:0::', {digits}, '%eth0')
          WHEN 4 THEN concat(' [2A00:1450:4001::0:', {digits}, ':0:0] ')
          WHEN 5 THEN concat('ff02::', {digits})
          ELSE concat('2600::', {digits}, '::1') END AS given""")


@query
def q39_v6_addresses(spark, folder):
    """Every page's address as a header names it: canonical text, class, and whether it lies in two networks."""
    rows = v6_texts(spark, folder).select("id", F.expr(ip.header_address("given")).alias("address"))
    return rows.select(
        "id", "address", F.expr(ip.address_class("address")).alias("class"),
        F.expr(ip.in_networks("address", ("2001:db8::/32", "10.0.0.0/8", "fe80::/10"))).alias("inside"),
    )


@query
def q39_v6_messages(spark, folder):
    """Clients of live messages that came through a trusted proxy with an IPv6 address of its own."""
    body = F.struct(
        F.lit("2026-09-01T10:00:00+00:00").alias("time"), F.lit("2001:DB8::1").alias("ip"),
        F.concat(F.trim("given"), F.lit(", 10.0.0.7")).alias("x_forwarded_for"), F.lit("GET").alias("method"), F.lit("/").alias("uri"), F.lit(200).alias("status"),
    )
    feed = v6_texts(spark, folder).select("id", F.concat(F.lit("wa_1_access: "), F.to_json(body)).alias("value"))
    options = OPTIONS.with_changes(trusted_proxies=("10.0.0.0/8", "2001:db8::/32"))
    return parse.parse_messages(feed, options).select("id", "remote_addr")


@query
def q39_named_periods(spark, folder):
    """Requests within each named period at a noon in Shanghai."""
    rows, out = visits(spark, folder), None
    for name in PERIODS:
        period = period_range(name, 1789444800, "Asia/Shanghai")
        part = within(rows, "timestamp", period.start, period.end).groupBy("site_id").agg(F.count("*").alias("requests")).withColumn("period", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query
def q39_report_top(spark, folder):
    """The ten most requested paths in the report of site 1."""
    rows = enrich(visits(spark, folder), OPTIONS)
    tables = {"dimension_day": U.dimension_partials(rows, ("uri", "ip")), "metric_minute": U.metric_partials(rows), "unique_hll_hour": U.unique_hll_hour(rows, OPTIONS)}
    return reports.report(tables, 1, Period(1788220800, 1789948800))["top_uri"].select("name", "requests")


@query
def q39_switched_off(spark, folder):
    """A site that its user switched off stays off when the panel's sites are registered again."""
    sites = S.set_enabled(nations(spark, folder), 1, False)
    return S.active(S.register(sites, _discovered(spark, folder))["sites"]).select("id", "name")
