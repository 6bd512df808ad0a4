"""Time the headline queries; prints one JSON line.

Every query runs over whole tables to a sink that reads all rows. The faster of two runs
counts, so that class loading and code generation are not measured.
"""

from __future__ import annotations

import json
import os
import time
from pathlib import Path

from pyspark.sql import functions as F

from hitfold.session import local_session, scratch_path
from hitfold.sources.logs import stream_messages
from hitfold.store import Store
from hitfold.streaming import live
from suite.access import OPTIONS, access
from suite.queries import QUERIES, messages

HEADLINE = (
    "q01_minute_metrics", "q02_spider_minute", "q03_dimension_day", "q04_overview",
    "q05_trend_dense", "q06_spider_report", "q07_rank_uri", "q08_rank_ip", "q09_clients",
    "q10_request_search", "q11_site_summary", "q12_period_compare", "q13_parse_roundtrip",
    "q14_hll_relational", "q15_hll_sketch", "q16_geo_range_join", "q17_retention",
    "q18_site_merge", "q19_migrate_exact", "q20_client_ip", "q21_url_path", "q22_csv_guard",
    "q24_parse_messages", "q26_store_history",
)


def live_latency(spark, folder: str, batches: int = 5) -> float:
    """Median seconds from the moment that a hundredth of the events lies in the feed until a reader of the store counts it."""
    feed, store = scratch_path(spark, "feed"), Store(spark, scratch_path(spark, "store"), OPTIONS.with_changes(trusted_proxies=())).create()
    rows = access(spark, folder)
    sites = spark.createDataFrame([(i, i) for i in range(1, 6)], "id bigint, panel_site_id bigint")
    messages(rows.where("id < 0")).select("value").write.text(feed)
    running = live.start_live(stream_messages(spark, feed), store, lambda: sites, scratch_path(spark, "checkpoint"))
    seen, waits = 0, []
    for k in range(batches):
        part = messages(rows.where(F.col("id") % 100 == k)).select("value").persist()
        seen += part.count()
        part.coalesce(1).write.mode("append").text(feed)
        landed = time.perf_counter()
        while (store.partials("metric_minute").agg(F.sum("requests")).first()[0] or 0) < seen and time.perf_counter() - landed < 60:
            time.sleep(0.05)
        waits.append(time.perf_counter() - landed)
    running.stop()
    return round(sorted(waits)[batches // 2], 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    memory = os.environ.get("BENCH_MEMORY", "12g")
    spark = local_session("bench", cores, **{"spark.driver.memory": memory})
    events = spark.read.parquet(f"{folder}/events.parquet").count()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        runs = []
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(min(runs), 3)
    latency = live_latency(spark, folder)
    print(
        json.dumps(
            {
                "metric": "total of headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "lines_parsed_per_sec": round(events / seconds["q13_parse_roundtrip"]),
                "events": events,
                "live_latency_sec": latency,
                "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
