"""Batches in the store, replays, compaction, expiry, and streams against batch results."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from hitfold.functions.sketch import sketch_counts
from hitfold.operators import rollup as U
from hitfold.operators.enrich import enrich
from hitfold.operators.parse import parse_messages
from hitfold.options import Options
from hitfold.plans import reports
from hitfold.plans.periods import Period
from hitfold.schema import SITE
from hitfold.sources import exports, logs
from hitfold.store import Store
from hitfold.streaming import live

OPTIONS = Options(salt="s")
NOW = 1788318000
DAY = 86400


def judged(spark, *rows):
    data = [(1, ts, f"1.1.1.{n}", "GET", "/p", 404 if n == 9 else 200, 10, "-", "Googlebot" if n % 2 else "Mozilla", "log", "accepted")
            for ts, n in rows]
    return spark.createDataFrame(data, "site_id bigint, timestamp bigint, remote_addr string, method string, uri string, status int, "
                                       "body_bytes bigint, referer string, user_agent string, file_path string, verdict string")


def requests_in(store):
    return store.merged("metric_minute").agg(F.sum("requests")).first()[0]


def test_a_replayed_batch_counts_once_and_compaction_keeps_totals(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), OPTIONS).create()
    assert store.merged("metric_minute").count() == 0
    first = judged(spark, (NOW, 1), (NOW + 1, 2), (NOW - 3 * DAY, 9))
    store.ingest("b-0", first)
    store.ingest("b-1", judged(spark, (NOW + 2, 1), (NOW + 70, 4)), stage=False)
    store.ingest("b-0", first)
    assert requests_in(store) == 5
    before = sorted(map(tuple, store.merged("dimension_day").collect()))
    uniques = tuple(sketch_counts(store.partials("unique_hll_hour"), ["site_id"]).first())
    assert uniques == (1, 4, 4)
    assert store.compact() is not None and len(store.active_batches()) == 1
    assert sorted(map(tuple, store.merged("dimension_day").collect())) == before
    assert tuple(sketch_counts(store.partials("unique_hll_hour"), ["site_id"]).first()) == uniques
    assert store.partials("metric_minute").count() == store.merged("metric_minute").count()
    assert store.reclaim(NOW, grace=0) >= 12 and requests_in(store) == 5
    assert live.ingest_progress(store).first().events == 5
    assert store.compact() is None


def test_an_uncommitted_batch_is_invisible(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), OPTIONS).create()
    store.ingest("b-0", judged(spark, (NOW, 1)))
    rows = U.metric_minute(enrich(judged(spark, (NOW, 2)), OPTIONS)).withColumn("day", F.current_date())
    store._write("metric_minute", "half", rows)
    assert requests_in(store) == 1


def test_expiry(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), OPTIONS).create()
    store.ingest("b-0", judged(spark, (NOW, 1), (NOW - 8 * DAY, 1), (NOW - 8 * DAY, 9), (NOW - 40 * DAY, 9), (NOW - 100 * DAY, 1)))
    assert sorted(NOW - r.timestamp for r in store.details(NOW).collect()) == [0, 8 * DAY]
    assert store.reclaim(NOW, grace=0) == 3  # two days of details, one day of dimensions
    assert store.partials("request_detail").count() == 3
    assert requests_in(store) == 5
    store.compact(NOW)
    assert store.partials("request_detail").count() == 2
    assert requests_in(store) == 5
    assert store.reclaim(NOW, rollup_days=90, grace=0) > 0 and requests_in(store) == 4


def test_merging_and_dropping_sites(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), OPTIONS).create()
    rows = judged(spark, (NOW, 1), (NOW + 1, 2))
    store.ingest("b-0", rows)
    store.ingest("b-1", rows.limit(1).withColumn("site_id", F.lit(2).cast("bigint")))
    store.merge_sites(spark.createDataFrame([(2, 1)], "site_id bigint, canonical_id bigint"))
    assert requests_in(store) == 2 and store.partials("request_detail").count() == 3
    store.drop_sites(spark.createDataFrame([(1,)], "site_id bigint"))
    assert requests_in(store) is None


def feed_text(site, ts, ip, uri="/"):
    body = {"time": f"2026-09-01T10:{ts // 60:02d}:{ts % 60:02d}+00:00", "ip": ip, "method": "GET", "uri": uri, "status": 200, "bytes": 7, "ua": "Mozilla"}
    return f"<190>x wa_{site}_access: {json.dumps(body)}"


def sites(spark):
    return spark.createDataFrame([(1, 17, "a", "", "/logs/a.log", "nginx", True, True), (2, 18, "b", "", "/logs/b.log", "nginx", True, True)], SITE)


def test_a_live_stream_equals_the_batch_and_survives_a_restart(spark, tmp_path):
    feed = tmp_path / "feed"
    feed.mkdir()
    texts = [feed_text(17 + n % 2, n * 7, f"8.8.8.{n % 5}") for n in range(60)] + ["junk", feed_text(99, 1, "8.8.8.8")]
    for n in range(4):
        (feed / f"{n}.txt").write_text("\n".join(texts[n::4]) + "\n")
    store = Store(spark, str(tmp_path / "s"), OPTIONS).create()

    def run():
        counters = live.Counters()
        spark.streams.addListener(counters)
        stream = logs.stream_messages(spark, str(feed), files_per_trigger=2)
        live.start_live(stream, store, lambda: sites(spark), str(tmp_path / "c"), available_now=True).awaitTermination()
        spark.streams.removeListener(counters)

    run()
    run()
    assert len(store.active_batches()) == 2
    batch = live.route(parse_messages(spark.createDataFrame([(t,) for t in texts], "value string"), OPTIONS), sites(spark), OPTIONS)
    assert {(r.site_id, r.verdict): r.messages for r in live.verdict_counts(batch).collect()} == {
        (1, "accepted"): 30, (2, "accepted"): 30, (None, "rejected"): 2}
    expected = U.metric_minute(enrich(batch.where("verdict = 'accepted'"), OPTIONS))
    same = lambda df: sorted(map(tuple, df.collect()))
    assert same(store.merged("metric_minute")) == same(expected)
    (feed / "late.txt").write_text(feed_text(17, 0, "8.8.4.4") + "\n")
    run()
    assert requests_in(store) == 61


def test_sites_being_loaded_wait_and_a_switched_off_store_rejects(spark):
    parsed = parse_messages(spark.createDataFrame([(feed_text(17, 1, "8.8.8.8"),), (feed_text(18, 1, "8.8.8.8", "/x/y"),)], "value string"), OPTIONS)
    busy = spark.createDataFrame([(1,)], "site_id bigint")
    verdict = lambda o, b=None: {r.panel_site_id: r.verdict for r in live.route(parsed, sites(spark), o, b).collect()}
    assert verdict(OPTIONS, busy) == {17: "deferred", 18: "accepted"}
    assert verdict(OPTIONS.with_changes(enabled=False)) == {17: "rejected", 18: "rejected"}
    assert verdict(OPTIONS.with_changes(excluded_paths=("/x",))) == {17: "accepted", 18: "rejected"}


def log_line(day, ip, month="Sep"):
    return f'{ip} - - [{day:02d}/{month}/2026:10:20:30 +0000] "GET / HTTP/1.1" 200 5 "-" "Mozilla"\n'


def test_history_loads_resume_and_skip_old_lines(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    (folder / "a.log-1").write_text(log_line(1, "8.8.8.1") + log_line(1, "8.8.8.1", "Jul") + "junk\n")
    store = Store(spark, str(tmp_path / "s"), OPTIONS).create()
    known = sites(spark).withColumn("log_path", F.concat(F.lit(f"{folder}/"), "name", F.lit(".log")))

    def run():
        lines = logs.stream_lines(spark, str(folder), "*.log*")
        live.start_history(lines, store, known, str(tmp_path / "c"), 1788393600 + DAY).awaitTermination()

    run()
    run()
    assert requests_in(store) == 1
    (folder / "a.log-2").write_text(log_line(2, "8.8.8.2"))
    run()
    progress = live.ingest_progress(store).first()
    assert tuple(progress) == (1, 4, 2, 2)
    answers = reports.dashboard(store.tables(), 1, Period(1788220800, 1788393600, DAY))
    top = answers["overview"].first()
    assert (top.requests, top.pv, top.uv, top.ip, top.body_bytes) == (2, 2, 2, 2, 10)
    assert [r.requests for r in answers["trend"].orderBy("timestamp").collect()] == [1, 1]


def write_lines(path, days):
    path.write_text("".join(log_line(d, f"8.8.8.{d}") for d in days))


def test_rotated_files_load_once_whatever_their_names(spark, tmp_path):
    folder = tmp_path / "my logs"  # a space is escaped in the reader's paths
    folder.mkdir()
    store = Store(spark, str(tmp_path / "s"), OPTIONS).create()
    known = sites(spark).withColumn("log_path", F.concat(F.lit(f"{folder}/"), "name", F.lit(".log")))
    load = lambda batch: live.load_closed(store, known, str(folder), batch)
    write_lines(folder / "a.log", (1, 2))
    assert load("1") == 0 and not requests_in(store)  # still written to
    write_lines(folder / "a.log", (1, 2, 3))
    (folder / "a.log").rename(folder / "a.log.1")
    write_lines(folder / "a.log", (4,))
    assert load("2") == 1 and requests_in(store) == 3
    (folder / "a.log.1").rename(folder / "a.log.2")
    (folder / "a.log").rename(folder / "a.log.1")
    assert load("3") == 1 and requests_in(store) == 4
    store.compact()
    with gzip.open(folder / "a.log.2.gz", "wb") as out:
        out.write((folder / "a.log.2").read_bytes())
    (folder / "a.log.2").unlink()
    assert load("4") == 0 and requests_in(store) == 4


def test_lines_of_unknown_files_are_counted(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    for name, days in (("a.log.1", (1, 2)), ("unknown.log.1", (3,))):
        write_lines(folder / name, days)
    store = Store(spark, str(tmp_path / "s"), OPTIONS).create()
    known = sites(spark).withColumn("log_path", F.concat(F.lit(f"{folder}/"), "name", F.lit(".log")))
    assert live.load_closed(store, known, str(folder), "1") == 1
    stats = {r.site_id: (r.lines, r.events, r.rejected) for r in live.ingest_progress(store).collect()}
    assert stats == {1: (2, 2, 0), 0: (1, 0, 1)}
    more = known.unionByName(known.limit(1).withColumns({"id": F.lit(9).cast("long"), "log_path": F.lit(f"{folder}/unknown.log")}))
    assert live.load_closed(store, more, str(folder), "2") == 1 and requests_in(store) == 3


def test_equal_files_of_two_sites_are_two_files(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    store = Store(spark, str(tmp_path / "s"), OPTIONS).create()
    one = sites(spark).limit(1)
    known = one.withColumns({"id": F.lit(1).cast("long"), "log_path": F.lit(f"{folder}/b.log")}).unionByName(
        one.withColumns({"id": F.lit(2).cast("long"), "log_path": F.lit(f"{folder}/c.log")})
    )
    for name in ("a", "b", "c"):  # a belongs to no site and has the least path
        write_lines(folder / f"{name}.log.1", (1, 2))
    assert live.load_closed(store, known, str(folder), "1") == 2 and requests_in(store) == 4
    stats = {r.site_id: (r.lines, r.events, r.rejected) for r in live.ingest_progress(store).collect()}
    assert stats == {1: (2, 2, 0), 2: (2, 2, 0), 0: (2, 0, 2)}
    assert {(r.site_id, r.lines) for r in store.partials("ingested_files").collect()} == {(1, 2), (2, 2)}
    more = known.unionByName(one.withColumns({"id": F.lit(3).cast("long"), "log_path": F.lit(f"{folder}/a.log")}))
    assert live.load_closed(store, more, str(folder), "2") == 1 and requests_in(store) == 6


def test_visible_batches_are_not_written_again(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), OPTIONS).create()
    rows = judged(spark, (NOW, 1))
    assert store.ingest("b", rows) and not store.ingest("b", rows) and requests_in(store) == 1
    store.compact()
    with pytest.raises(ValueError, match="compacted"):
        store.ingest("b", rows)
    assert not store.ingest("b", rows, replay=True) and requests_in(store) == 1


def test_a_failed_batch_stays_invisible_and_is_written_anew(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"), OPTIONS).create()
    with monkeypatch.context() as m:
        m.setattr(Store, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            store.ingest("b", judged(spark, (NOW, 1)))
    assert not requests_in(store)
    assert store.ingest("b", judged(spark, (NOW, 1))) and requests_in(store) == 1


def test_rewrites_exclude_each_other(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"), OPTIONS).create()
    store.ingest("b", judged(spark, (NOW, 1)))
    inner = []
    real = Store._commit

    def commit(self, batch, replaces=None):
        if replaces:
            with pytest.raises(RuntimeError, match="another rewrite"):
                store.compact(full=True)
            inner.append(batch)
        real(self, batch, replaces)

    monkeypatch.setattr(Store, "_commit", commit)
    store.compact()
    assert inner and requests_in(store) == 1
    stale = store.active_batches()
    store.compact(full=True)
    with pytest.raises(RuntimeError, match="replaced"):
        store._rewrite(stale, lambda table, rows: rows)
    assert requests_in(store) == 1


def test_windowed_stream(spark, tmp_path):
    feed = tmp_path / "feed"
    feed.mkdir()
    (feed / "0.txt").write_text("".join(feed_text(17, n * 10, "8.8.8.8") + "\n" for n in range(12)))
    parsed = live.observed(parse_messages(logs.stream_messages(spark, str(feed)), OPTIONS))
    events = parsed.withColumn("site_id", F.col("panel_site_id"))
    query = (live.windowed_metrics(events, OPTIONS).writeStream.outputMode("update").format("memory")
             .queryName("minutes").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start())
    query.awaitTermination()
    rows = spark.table("minutes").groupBy("minute_ts").agg(F.max("requests").alias("n")).collect()
    assert sorted(r.n for r in rows) == [6, 6]


def test_reads_prune_folders_and_push_filters(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), OPTIONS).create()
    store.ingest("b-0", judged(spark, (NOW, 1), (NOW - 40 * DAY, 2)))
    answers = reports.dashboard(store.tables(), 1, Period(NOW - DAY, NOW + 1))
    plan = answers["overview"]._jdf.queryExecution().executedPlan().toString()
    pruned = [part.split("]")[0] for part in plan.split("PartitionFilters: [")[1:]]
    assert pruned and all("batch#" in p and "day#" in p for p in pruned)
    assert "EqualTo(site_id,1)" in plan and "GreaterThanOrEqual(minute_ts" in plan
    pages = reports.request_page(store.tables(), 1, Period(NOW - DAY, NOW + 1), query="1.1.1")
    assert [r.remote_addr for r in pages["items"].collect()] == ["1.1.1.1"]
    assert pages["total"].first().total == 1
    report = reports.report(store.tables(), 1, Period(NOW - DAY, NOW + 1))
    assert report["top_uri"].first().name == "/p" and report["top_ip"].count() == 1
    assert reports.resolve_site(sites(spark), 2) == 2 and reports.resolve_site(sites(spark), 9) == 1
    assert reports.clients(store.tables(), 1, Period(NOW - DAY, NOW + 1)).count() == 3
    reports.export_requests(store.tables(), 1, Period(NOW - DAY, NOW + 1), str(tmp_path / "csv"))
    text = "".join(p.read_text() for p in (tmp_path / "csv").glob("*.csv"))
    assert ",1.1.1.1,GET,/p,200,10,Other,Other,Bot,Googlebot" in text
    assert exports.report_rows(report["top_uri"]).columns == list(exports.REPORT_COLUMNS)
