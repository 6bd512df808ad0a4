"""Streams into the store.

Each micro-batch goes through the batch operators and is stored as partials under its batch id, so
events of any lateness update their own minute and a replayed batch counts once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from hitfold.functions import requests as R
from hitfold.functions.columns import flag
from hitfold.operators import parse as P
from hitfold.operators.enrich import enrich
from hitfold.options import DAY, Options
from hitfold.sources import logs
from hitfold.store import Store
from hitfold.streaming.closed import load_closed, progress

__all__ = ["ingest_progress", "load_closed", "start_history", "start_live"]

OBSERVED = "ingest"
LIVE_TRIGGER = "1 second"


def route(
    events: DataFrame, sites: DataFrame, options: Options, backfilling: DataFrame | None = None
) -> DataFrame:
    """Give each parsed message its ``site_id`` and a verdict.

    ``verdict`` is ``accepted``, ``rejected`` (unparsed, switched off, excluded or of an
    unknown site) or ``deferred`` (its site is being loaded from files, which then are the only source).
    """
    known = sites.where(F.col("panel_site_id") > 0).groupBy("panel_site_id").agg(
        F.min("id").alias("site_id")
    )
    routed = events.join(known, "panel_site_id", "left")
    ok = P.accept_condition(options) & F.col("site_id").isNotNull() & F.lit(options.enabled)
    verdict = F.when(~ok, F.lit(P.REJECTED))
    if backfilling is not None:
        busy = backfilling.select("site_id").distinct().withColumn("_busy", F.lit(True))
        routed = routed.join(busy, "site_id", "left")
        verdict = verdict.when(F.col("_busy"), F.lit(P.DEFERRED))
    return routed.withColumn("verdict", verdict.otherwise(F.lit(P.ACCEPTED))).drop("_busy")


def verdict_counts(routed: DataFrame) -> DataFrame:
    """Messages per site and verdict; messages without a site have a null ``site_id``."""
    return routed.groupBy("site_id", "verdict").agg(F.count("*").alias("messages"))


def observed(parsed: DataFrame) -> DataFrame:
    """Attach accept and reject counters that a query listener can read."""
    return parsed.observe(
        OBSERVED,
        F.count("*").alias("lines"),
        F.count_if(F.col("timestamp").isNotNull()).alias("parsed"),
        F.count_if(F.col("timestamp").isNull()).alias("rejected"),
    )


class Counters(StreamingQueryListener):
    """Counters of running queries: per site (0 for none) those of the batches that became visible, and what ``observed`` sees.

    Pass it to ``start_live``, which adds the statistics of every batch as they are written; a batch that is replayed counts
    once. As a listener it adds up the metrics that ``observed`` attaches to a stream.
    """

    def __init__(self):
        self.lines = self.parsed = self.rejected = 0
        self.sites: dict[int, dict[str, int]] = {}

    def add(self, rows: list) -> None:
        for row in rows:
            held = self.sites.setdefault(row.site_id, dict.fromkeys(("lines", "events", "rejected", "deferred"), 0))
            for name in ("lines", "events", "rejected"):
                held[name] += row[name]
            held["deferred"] += row.lines - row.events - row.rejected

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        row = event.progress.observedMetrics.get(OBSERVED)
        if row is not None:
            self.lines += row.lines
            self.parsed += row.parsed
            self.rejected += row.rejected

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass


def start_live(
    messages: DataFrame, store: Store, sites: Callable[[], DataFrame], checkpoint: str,
    source: str = "live", backfilling: Callable[[], DataFrame | None] = lambda: None,
    available_now: bool = False, trigger: str = LIVE_TRIGGER, counters: Counters | None = None,
    fold_every: int | None = 32,
) -> StreamingQuery:
    """Fold a stream of live messages into the store.

    ``sites`` and ``backfilling`` are asked once per micro-batch, so both may change while it runs. ``counters`` follow what becomes
    visible. Every ``fold_every`` micro-batches the store is folded, so that the batches a reader meets stay few however long it runs.
    With ``available_now`` a backlog of any size is read, whose micro-batches are staged in the shared folder rather than cached.
    """
    options = store.options

    def write(batch: DataFrame, batch_id: int) -> None:
        parsed = P.parse_messages(batch.select("value"), options)
        routed = route(parsed, sites(), options, backfilling())
        store.ingest(
            f"{source}-{batch_id}", routed.withColumn("file_path", F.lit(source)), stage=available_now,
            replay=True, counted=None if counters is None else counters.add,
        )
        if fold_every and batch_id % fold_every == fold_every - 1:
            store.fold(fold_every)

    writer = messages.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    if available_now:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=trigger).start()


def start_history(
    lines: DataFrame, store: Store, sites: DataFrame, checkpoint: str, now: int,
    source: str = "history", days: int | None = 30, detail_days: int | None = 7, trigger: str | None = None,
) -> StreamingQuery:
    """Load streamed log lines, then stop; rerun to resume. With a ``trigger`` (an interval) it goes on.

    ``follow.follow_lines`` streams logs that are being written and rotated. ``logs.stream_lines`` streams files under names of their own, for folders where files
    neither grow nor change names; ``load_closed`` is for rotated logs in batches. Lines older than ``days`` are rejected
    (None: none), details are kept for ``detail_days``, failed ones as long as lines.
    """
    since = 0 if days is None else now - days * DAY
    detail_since = 0 if detail_days is None else now - detail_days * DAY

    def write(batch: DataFrame, batch_id: int) -> None:
        load_lines(
            batch, store, sites, f"{source}-{batch_id}", since, detail_since, since, replay=True
        )

    writer = lines.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return writer.trigger(**({"availableNow": True} if trigger is None else {"processingTime": trigger})).start()


def load_lines(
    lines: DataFrame, store: Store, sites: DataFrame, batch: str, since: int = 0,
    detail_since: int = 0, error_since: int = 0, replay: bool = False,
    files: DataFrame | None = None,
) -> None:
    """Parse log lines once and fold them into one batch of the store.

    Lines of files that belong to no site are counted as rejected, without a site.
    """
    judged = P.judge(P.parse_lines(lines), store.options, since)
    store.ingest(batch, judged, detail_since, error_since, sites=sites, replay=replay, files=files)


def windowed_metrics(
    events: DataFrame, options: Options, lateness: str = "1 hour"
) -> DataFrame:
    """Minute metrics as a stateful stream, for update-mode sinks.

    The watermark bounds the state; events later than that are dropped here,
    while the partials path takes them all.
    """
    timed = enrich(events, options).withColumn("event_time", F.timestamp_seconds("timestamp"))
    return (
        timed.withWatermark("event_time", lateness)
        .groupBy("site_id", F.window("event_time", "1 minute").alias("w"))
        .agg(
            F.count("*").alias("requests"),
            F.sum("pv").alias("pv"),
            F.sum("body_bytes").alias("body_bytes"),
            F.sum(flag(R.error_in_range(F.col("status")))).alias("errors"),
            F.sum(flag(F.col("is_bot"))).alias("bot_requests"),
        )
        .select(
            "site_id", F.unix_seconds("w.start").alias("minute_ts"),
            "requests", "pv", "body_bytes", "errors", "bot_requests",
        )
    )


def ingest_progress(store: Store) -> DataFrame:
    """Counters per site over all batches."""
    return progress(store)
