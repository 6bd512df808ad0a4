"""Folding, merging, sketches, details, sites."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from hitfold.functions.sketch import exact_counts, register_counts, sketch_counts
from hitfold.operators import rollup as U
from hitfold.operators import sites as S
from hitfold.operators.enrich import details, enrich, keep_details
from hitfold.operators.retention import retained_days, retained_details
from hitfold.options import Options
from hitfold.schema import METRIC_MINUTE, SITE, UNIQUE_HOUR

OPTIONS = Options(salt="s")
SCHEMA = ("site_id bigint, timestamp bigint, remote_addr string, uri string, status int, "
          "body_bytes bigint, user_agent string")


def events(spark, *rows, site=1):
    df = spark.createDataFrame([(site, *r) for r in rows], SCHEMA)
    return enrich(df.withColumns({"method": F.lit("GET"), "referer": F.lit("-")}), OPTIONS)


CRAWL = (
    (1788314400, "1.1.1.1", "/", 200, 100, "Googlebot"),
    (1788314460, "1.1.1.2", "/bad", 500, 50, "Googlebot"),
    (1788314460, "1.1.1.3", "/", 200, 80, "Baiduspider"),
)


def test_metrics_of_a_small_log(spark):
    rows = events(spark, (60, "1.1.1.1", "/", 200, 100, "Mozilla"), (61, "1.1.1.2", "/app.js", 200, 200, "Mozilla"),
                  (119, "1.1.1.1", "/missing", 404, 50, "Mozilla"), (120, "1.1.1.1", "/x", 600, 0, "bot"))
    out = {r.minute_ts: tuple(r)[2:] for r in U.metric_minute(rows).collect()}
    assert out == {60: (3, 1, 350, 1, 0), 120: (1, 0, 0, 0, 1)}
    days = {r.value: r.errors for r in U.dimension_day(rows, ("uri",)).collect()}
    assert days == {"/": 0, "/app.js": 0, "/missing": 1, "/x": 1}
    uniques = exact_counts(U.unique_values(rows, OPTIONS), ["site_id"]).first()
    assert (uniques.uv, uniques.ip) == (3, 2)


def test_crawlers_and_cube(spark):
    rows = events(spark, *CRAWL)
    spiders = {(r.minute_ts, r.spider): (r.requests, r.body_bytes, r.errors) for r in U.spider_minute(rows).collect()}
    assert spiders == {(1788314400, "Googlebot"): (1, 100, 0), (1788314460, "Googlebot"): (1, 50, 1),
                       (1788314460, "Baiduspider"): (1, 80, 0)}
    cube = U.traffic_cube(rows)
    same = lambda a, b: sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert same(U.metric_from_cube(cube), U.metric_minute(rows))
    assert same(U.spider_from_cube(cube), U.spider_minute(rows))
    assert same(U.clients_from_cube(cube), U.dimension_day(rows, U.CLIENT_DIMENSIONS))


def test_details_are_whole_and_kept_by_age(spark):
    rows = events(spark, (1000, "1.1.1.1", "/old", 200, 10, "x"), (1100, "1.1.1.2", "/old-error", 404, 20, "x"),
                  (2000, "1.1.1.3", "/recent?q=1", 200, 30, "y" * 2000), (400, "1.1.1.3", "/gone", 500, 30, "y"))
    kept = details(keep_details(rows, 1500, 500)).collect()
    assert sorted(r.uri for r in kept) == ["/old-error", "/recent"]
    assert max(len(r.user_agent) for r in kept) == 2000
    assert keep_details(rows).count() == 4


def test_retention(spark):
    rows = details(events(spark, (10, "a", "/", 200, 1, ""), (20, "a", "/", 200, 1, ""),
                          (5, "a", "/", 400, 1, ""), (3, "a", "/", 700, 1, "")))
    assert sorted(r.timestamp for r in retained_details(rows, 20, 5).collect()) == [5, 20]
    days = spark.createDataFrame([("2024-01-01",), ("2024-01-02",)], "d string").select(F.to_date("d").alias("day"))
    assert retained_days(days, "2024-01-02").count() == 1 and retained_days(days, "").count() == 2


def test_sketches_small_and_large(spark):
    values = spark.createDataFrame([(v,) for v in "abcc"], "value string").select(
        F.lit(1).cast("bigint").alias("site_id"), F.lit(0).cast("bigint").alias("hour_ts"),
        F.lit("uv").alias("kind"), "value")
    small = sketch_counts(U.sketches_of_values(values, 10), ["site_id"]).first()
    assert (small.uv, small.ip) == (3, 0)
    many = spark.range(10000).select(
        F.lit(1).alias("site_id"), ((F.col("id") % 2) * 3600).alias("hour_ts"), F.lit("uv").alias("kind"),
        F.col("id").cast("string").alias("value"))
    merged = sketch_counts(U.sketches_of_values(many, 10), ["site_id"]).first().uv
    assert abs(merged - 10000) < 800
    registers = register_counts(many, ["site_id"]).first().estimate
    assert abs(registers - 10000) < 800
    united = U.add(U.sketches_of_values(values, 10), U.sketches_of_values(values, 10), UNIQUE_HOUR)
    assert united.count() == 1
    with pytest.raises(PySparkException):
        U.add(U.sketches_of_values(values, 10), U.sketches_of_values(values, 12), UNIQUE_HOUR).collect()


def test_legacy_rows_become_sketches(spark):
    visitors = spark.createDataFrame([(1, "2026-09-01", "h", 1788314460)], "site_id long, day string, visitor_hash string, first_minute long")
    addresses = visitors.withColumnRenamed("visitor_hash", "ip_hash")
    out = U.migrate_exact(visitors, addresses)
    assert {(r.hour_ts, r.kind) for r in out.collect()} == {(1788314400, "uv"), (1788314400, "ip")}
    again = U.migrate_exact(visitors, addresses, existing=out)
    counts = sketch_counts(again, ["site_id"]).first()
    assert (counts.uv, counts.ip) == (1, 1)


def test_rebuild_only_fills_gaps(spark):
    rows = events(spark, *CRAWL)
    full = U.dimension_day(rows)
    existing = full.where("dimension != 'ip'").withColumn("requests", F.lit(99).cast("bigint"))
    rebuilt = U.rebuild_dimensions(existing, details(rows))
    assert {r.requests for r in rebuilt.where("dimension != 'ip'").collect()} == {99}
    assert rebuilt.where("dimension = 'ip'").count() == 3


# -- sites ---------------------------------------------------------------------------

def sites(spark, *rows):
    return spark.createDataFrame([(i, p, n, "", path, "nginx", True, True) for i, p, n, path in rows], SITE)


def found(spark, *rows):
    return spark.createDataFrame([(p, n, "/r", path, "apache") for p, n, path in rows],
                                 "panel_site_id bigint, name string, document_root string, log_path string, web_server string")


def test_merging_keeps_the_larger_record(spark):
    cols = "site_id bigint, minute_ts bigint, requests bigint, pv bigint, body_bytes bigint, errors bigint, bot_requests bigint"
    rows = spark.createDataFrame([(1, 1788314400, 4, 2, 400, 0, 0), (1, 1788314400, 6, 4, 600, 1, 0),
                                  (2, 1788314400, 3, 2, 300, 0, 0), (2, 1788314460, 2, 1, 200, 0, 0)], cols)
    mapping = S.merge_map(sites(spark, (1, 7, "a", "/a"), (2, 7, "b", "/b")))
    merged = S.merge_rollup(rows, mapping, METRIC_MINUTE)
    total = merged.agg(F.sum("requests"), F.sum("pv")).first()
    assert tuple(total) == (12, 7) and merged.select("site_id").distinct().count() == 1


def test_register_matches_panel_then_path(spark):
    known = sites(spark, (1, 7, "old", "/logs/a.log;"), (2, 7, "dup", "/logs/b.log"), (3, -1, "orphan", "/logs/a.log"),
                  (4, 0, "bare", "/logs/c.log"), (5, 9, "gone", "/logs/d.log"))
    out = S.register(known, found(spark, (7, "new", "/logs/a.log"), (8, "bare", "/logs/c.log"), (11, "fresh", "/logs/e.log"),
                                  (-1, "loose", "/logs/f.log")))
    rows = {r.id: (r.panel_site_id, r.name, r.log_path) for r in out["sites"].collect()}
    assert rows[1] == (7, "new", "/logs/a.log") and rows[4] == (8, "bare", "/logs/c.log")
    assert rows[5] == (9, "gone", "/logs/d.log") and 2 not in rows and 3 not in rows
    assert {rows[6], rows[7]} == {(11, "fresh", "/logs/e.log"), (-1, "loose", "/logs/f.log")}
    assert {tuple(r) for r in out["merges"].collect()} == {(2, 1), (3, 1)}
    assert [r.site_id for r in out["rebuilds"].collect()] == [1]


def test_site_switches_search_and_order(spark):
    known = sites(spark, (1, 1, "beta", "/b"), (2, 2, "Alpha", "/a"), (3, 3, "gamma", "/c"))
    off = S.set_enabled(known, 1, False)
    again = S.register(off, found(spark, (1, "beta", "/b")))["sites"]
    assert {r.id for r in S.active(again).collect()} == {2, 3}
    kept = S.retain(known, found(spark, (2, "x", "/a")))
    assert {r.id: r.enabled for r in kept.collect()} == {1: False, 2: True, 3: False}
    assert [r.name for r in S.search(known, " ALP ").collect()] == ["Alpha"]
    progress = spark.createDataFrame([(1, 4, 3, 1), (1, 1, 1, 0)], "site_id bigint, lines bigint, events bigint, rejected bigint")
    assert [(r.name, r.lines) for r in S.list_sites(known, progress).collect()] == [("Alpha", 0), ("beta", 5), ("gamma", 0)]
    ranked = known.withColumn("requests", F.when(F.col("id") == 3, 5).otherwise(1))
    assert [r.id for r in S.sort_sites(ranked, "requests", True).collect()] == [3, 1, 2]
    with pytest.raises(ValueError):
        S.sort_sites(ranked, "drop table")


def test_rows_are_numbered_in_order(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k"))
    out = S.number_rows(df, ["k"], "n").collect()
    assert all(r.n == r.k + 1 for r in out) and len(out) == 1000


def test_merge_of_legacy_rows_inserts_only_missing(spark):
    rows = spark.createDataFrame([(1, "d", "x", 5), (2, "d", "x", 3), (2, "d", "y", 9)], "site_id bigint, day string, h string, first_minute bigint")
    mapping = spark.createDataFrame([(2, 1)], "site_id bigint, canonical_id bigint")
    out = S.merge_exact(rows, mapping, ["site_id", "day", "h"])
    assert {tuple(r) for r in out.collect()} == {(1, "d", "x", 5), (1, "d", "y", 9)}
