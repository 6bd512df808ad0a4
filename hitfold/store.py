"""Rollup tables as Parquet partials: append batches, read merged, fold, expire.

Every batch writes its own folders and then one commit (``hitfold.commits``); readers take the
folders of committed batches only, by their names. A batch that is written again replaces its folder, so a replay after a failure
counts once. Measures merge in any order, so no row is ever updated in place; where sites are merged or dropped, the files that hold
them are hidden and their rows written anew, all other files stay.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass, field
from datetime import date, datetime, timedelta
from functools import reduce
from zoneinfo import ZoneInfo

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from hitfold.commits import CommitLog, State
from hitfold.functions import clock
from hitfold.operators import enrich as E
from hitfold.operators import parse as P
from hitfold.operators import retention
from hitfold.operators import rollup as R
from hitfold.operators.sites import merge_details, merge_rollup
from hitfold.options import Options
from hitfold.schema import DIMENSION_DAY, METRIC_MINUTE, ROLLUPS, SPIDER_MINUTE, UNIQUE_HOUR
from hitfold.session import remove_path, stored
from hitfold.sources import registry

DETAIL = "request_detail"
STATS = "ingest_stats"
FILES = "ingested_files"
SEEN = "seen_files"
PENDING = "pending_files"
COMMITS = "commits"
# Columns in storage order; ``batch`` and ``day`` are folders.
SCHEMAS = {
    METRIC_MINUTE.name: "site_id BIGINT, minute_ts BIGINT, requests BIGINT, pv BIGINT, "
    "body_bytes BIGINT, errors BIGINT, bot_requests BIGINT, batch STRING, day DATE",
    SPIDER_MINUTE.name: "site_id BIGINT, minute_ts BIGINT, spider STRING, requests BIGINT, "
    "body_bytes BIGINT, errors BIGINT, batch STRING, day DATE",
    DIMENSION_DAY.name: "site_id BIGINT, dimension STRING, value STRING, requests BIGINT, "
    "body_bytes BIGINT, errors BIGINT, last_seen BIGINT, batch STRING, day DATE",
    UNIQUE_HOUR.name: "site_id BIGINT, hour_ts BIGINT, kind STRING, sketch BINARY, "
    "batch STRING, day DATE",
    DETAIL: "id STRING, site_id BIGINT, timestamp BIGINT, remote_addr STRING, method STRING, "
    "uri STRING, status INT, body_bytes BIGINT, referer STRING, user_agent STRING, "
    "browser STRING, system STRING, device STRING, spider STRING, batch STRING, day DATE",
    STATS: "site_id BIGINT, file_path STRING, lines BIGINT, events BIGINT, rejected BIGINT, "
    "batch STRING, day DATE",
    FILES: "site_id BIGINT, lines BIGINT, digest STRING, file_path STRING, batch STRING, day DATE",
    # files as they lay in a folder when they were last read; site 0 stands for none
    SEEN: "site_id BIGINT, file_path STRING, length BIGINT, modified BIGINT, batch STRING, day DATE",
    # files of no site (0), under the name of their log
    PENDING: "site_id BIGINT, log STRING, lines BIGINT, digest STRING, batch STRING, day DATE",
}
_CLUSTERING = {
    METRIC_MINUTE.name: ("site_id", "minute_ts"),
    SPIDER_MINUTE.name: ("site_id", "minute_ts"),
    DIMENSION_DAY.name: ("site_id", "dimension"),
    UNIQUE_HOUR.name: ("site_id", "hour_ts"),
    DETAIL: ("site_id", "timestamp"),
    STATS: ("site_id",),
    FILES: ("digest",),
    SEEN: ("file_path",),
    PENDING: ("log",),
}
#: Columns of classified events that the tables are made of; all others end here, before events are staged or cached.
EVENTS = (
    "site_id", "file_path", "verdict", "timestamp", "remote_addr", "method", "path", "status", "body_bytes", "referer", "user_agent",
    "browser", "system", "device", "spider", "pv", "minute_ts", "hour_ts", "day", "id", "_hash",
)
#: Folders a rewrite spreads the sites of a day over, so that a later merge of sites touches few files.
SITE_BUCKETS = 16
LOCK = "_rewriting"


def fold(
    enriched: DataFrame, cube: DataFrame, options: Options, detail_since: int = 0,
    error_since: int = 0,
) -> dict[str, DataFrame]:
    """All stored tables of one set of events.

    Pass a stored or cached ``enriched`` and its cached traffic cube: the cube is small and
    serves three rollups, the events are read three times more, each time few columns.
    """
    by_minute = clock.local_day("minute_ts").alias("day")
    days = R.clients_from_cube(cube).unionByName(R.dimension_day(enriched, ("ip", "uri")))
    kept = E.keep_details(enriched, detail_since, error_since)
    return {
        METRIC_MINUTE.name: R.metric_from_cube(cube).select("*", by_minute),
        SPIDER_MINUTE.name: R.spider_from_cube(cube).select("*", by_minute),
        DIMENSION_DAY.name: days,
        UNIQUE_HOUR.name: R.unique_hll_hour(enriched, options).select(
            "*", clock.local_day("hour_ts").alias("day")
        ),
        DETAIL: E.details(kept),
    }


@dataclass
class Store:
    spark: SparkSession
    root: str
    options: Options = field(default_factory=Options)

    def path(self, table: str) -> str:
        return f"{self.root.rstrip('/')}/{table}"

    def __post_init__(self):
        self._tables: dict[str, list[str]] = {}

    @property
    def log(self) -> CommitLog:
        return CommitLog(self.spark, self.path(COMMITS))

    def create(self) -> "Store":
        """Make empty tables where there are none."""
        for table in SCHEMAS:
            target = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(table))
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(target)
        self.log.create()
        return self

    # -- batches -------------------------------------------------------------------

    def active_batches(self) -> list[str]:
        """Committed batches that no rewrite has replaced."""
        return sorted(self.log.state().active)

    def _write(self, table: str, batch: str, rows: DataFrame) -> None:
        columns = [part.split()[0] for part in SCHEMAS[table].split(", ")]
        columns.remove("batch")
        dealt = rows.select(*columns)
        if batch.startswith("base-"):
            dealt = dealt.withColumn("_bucket", F.pmod("site_id", F.lit(SITE_BUCKETS))).hint("rebalance", "day", "_bucket").drop("_bucket")
        else:
            dealt = dealt.hint("rebalance", "day")
        (
            dealt.sortWithinPartitions("day", *_CLUSTERING[table])
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "static")
            .partitionBy("day")
            .parquet(f"{self.path(table)}/batch={batch}")
        )

    def _commit(
        self, batch: str, replaces: list[str] | None = None, hidden: dict | None = None, stream: bool = False
    ) -> None:
        """Show a batch in place of others, or of the ``hidden`` files (by batch and table) of others."""

        def check(state: State) -> None:
            if {*(replaces or ()), *(hidden or ())} - set(state.active):
                raise RuntimeError("another rewrite has replaced some of these batches")

        change = {"add": {batch: self._tables.pop(batch, sorted(SCHEMAS))}, "remove": replaces or [], "hide": hidden or {}}
        if stream:
            source, _, number = batch.rpartition("-")
            if number.isdecimal():
                change["streams"] = {source: int(number)}
        self.log.commit(change, check)

    def append(self, batch: str, tables: dict[str, DataFrame], replay: bool = False) -> bool:
        """Write one batch; it becomes visible, whole, with its commit.

        A batch that is visible is never written again; False is returned. A name that a
        compaction has folded is refused, unless ``replay`` says that the caller repeats its batches by name, as streams do:
        names that end in numbers that only grow.
        """
        if self._known(batch, replay):
            return False
        self._write_all(batch, tables)
        self._commit(batch, [], None, replay)
        return True

    def _known(self, batch: str, replay: bool) -> bool:
        state = self.log.state()
        if batch in state.active:
            return True
        folded = state.folded(batch) if replay else batch in state.named
        if folded and not replay:
            raise ValueError(f"batch {batch!r} was stored before and has been compacted")
        return folded

    @contextmanager
    def _alone(self) -> Iterator[None]:
        """Only one rewrite of the store at a time: a file that is created if absent, which file systems do atomically.

        A rewrite that died leaves the file behind; remove it to go on.
        """
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(LOCK))
        system = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        try:
            made = system.createNewFile(path)
        except Exception as error:  # some file systems raise where others return false
            raise RuntimeError(f"{self.path(LOCK)}: another rewrite runs") from error
        if not made:
            raise RuntimeError(f"{self.path(LOCK)}: another rewrite runs")
        try:
            yield
        finally:
            system.delete(path, False)

    def _write_all(self, batch: str, tables: dict[str, DataFrame]) -> None:
        """The tables are independent jobs, so they share the cluster side by side."""
        self._tables[batch] = sorted(tables)
        write = inheritable_thread_target(self.spark)(self._write)
        with ThreadPoolExecutor(len(tables)) as pool:
            jobs = [pool.submit(write, table, batch, rows) for table, rows in tables.items()]
            for job in jobs:
                job.result()

    def ingest(
        self, batch: str, judged: DataFrame, detail_since: int = 0, error_since: int = 0,
        stage: bool = True, sites: DataFrame | None = None, replay: bool = False,
        files: DataFrame | None = None, counted: Callable[[list], None] | None = None,
    ) -> bool:
        """Fold judged events (with ``site_id``, ``file_path`` and ``verdict``) into one batch.

        Parsing and classifying happen once: a history load stages its rows in the shared
        folder, which also survives lost executors, and so does a backlog; a live micro-batch is small and is cached.
        Without ``site_id``, rows get their site from ``sites`` by their file; rows of no site are rejected.
        ``files`` (site_id, lines, digest, file_path) are remembered with the batch. See ``append`` for names used again.
        """
        if self._known(batch, replay):
            return False
        enriched = self.enriched(batch, judged)
        held, path = stored(enriched, "events") if stage else (enriched.persist(), None)
        owned = None
        try:
            rows = held
            if sites is not None:  # found once, not by the job of each table
                owners, owned = stored(registry.owners(held, sites), "owners")
                verdict = F.when(F.col("site_id").isNull(), F.lit(P.REJECTED)).otherwise(F.col("verdict"))
                rows = held.join(owners, "file_path", "left").withColumn("verdict", verdict)
            more = {} if files is None else {FILES: files.select("site_id", "lines", "digest", "file_path", F.current_date().alias("day"))}
            return self.ingest_enriched(batch, rows, detail_since, error_since, replay, more, counted)
        finally:
            if path is None:
                held.unpersist()
            for scratch in filter(None, (path, owned)):
                remove_path(self.spark, scratch)

    def enriched(self, batch: str, judged: DataFrame) -> DataFrame:
        """Events as the rollups read them, each with an id of the batch."""
        given = F.col("id") if "id" in judged.columns else F.monotonically_increasing_id()
        rows = E.enrich(judged, self.options).withColumn("id", F.concat(F.lit(f"{batch}:"), F.lpad(given.cast("string"), 20, "0")))
        return rows.select(*[c for c in EVENTS if c in rows.columns])

    def ingest_enriched(
        self, batch: str, rows: DataFrame, detail_since: int = 0, error_since: int = 0, replay: bool = False,
        more: dict[str, DataFrame] | None = None, counted: Callable[[list], None] | None = None,
    ) -> bool:
        """Fold stored or cached rows with a site and a verdict, and ``more`` tables, into one batch.

        ``counted`` is given the rows of the batch's statistics (site_id, lines, events, rejected) once the batch is visible. They are
        observed while they are written, so they are those of the table and cost no job.
        """
        stats = P.accounting(rows, ["site_id", "file_path"]).select(
            F.coalesce("site_id", F.lit(0)).alias("site_id"), "file_path", "lines",
            "events", "rejected", F.current_date().alias("day"),
        )
        seen = None
        if counted is not None:
            seen = Observation(f"statistics-{uuid.uuid4().hex}")
            one = F.struct("site_id", "lines", "events", "rejected")
            stats = stats.observe(seen, F.collect_list(one).alias("sites"))  # as many as the batch has sites and files
        events = P.accepted(rows)
        cube = R.traffic_cube(events).persist()
        try:
            tables = fold(events, cube, self.options, detail_since, error_since)
            stored_now = self.append(batch, {**tables, **(more or {}), STATS: stats}, replay)
            if stored_now and seen is not None:
                counted(seen.get["sites"])
            return stored_now
        finally:
            cube.unpersist()

    # -- reading -------------------------------------------------------------------

    def partials(self, table: str, batches: list[str] | None = None, state: State | None = None) -> DataFrame:
        """Rows of the committed batches; only their folders are listed and only the files that are shown are read."""
        state = state or self.log.state()
        shown = state.active if batches is None else {b: state.active[b] for b in batches if b in state.active}
        names = sorted(b for b, held in shown.items() if table in held["tables"])
        if not names:
            return self.spark.createDataFrame([], SCHEMAS[table])
        root = self.path(table)
        rows = self.spark.read.schema(SCHEMAS[table]).option("basePath", root).parquet(*[f"{root}/batch={b}" for b in names])
        hidden = sorted({f for b in names for f in shown[b].get("hidden", {}).get(table, ())})
        if hidden:
            rows = rows.where(~F.col("_metadata.file_name").isin(hidden))
        return rows.where(F.col("batch").isin(names))

    def tables(self, now: int | None = None) -> dict[str, DataFrame]:
        """Every table for the read API, which merges partials by itself; with ``now``, details
        within their retention only."""
        state = self.log.state()
        found = {name: self.partials(name, state=state) for name in SCHEMAS}
        return found if now is None else found | {DETAIL: self.details(now)}

    def merged(self, table: str) -> DataFrame:
        return R.merge(self.partials(table), ROLLUPS[table])

    def details(self, now: int) -> DataFrame:
        """Request details within their retention at ``now``."""
        limits = self.options.cutoffs(now)
        oldest = min(limits.values()) // 86400 - 1
        rows = self.partials(DETAIL).where(F.col("day") >= F.date_from_unix_date(F.lit(oldest)))
        return retention.retained_details(rows, **limits)

    # -- maintenance ---------------------------------------------------------------

    def _rewrite(self, batches: list[str], change, level: int = 1) -> str | None:
        """Write some batches as one, through ``change(table, rows)``, and swap them."""
        if not batches:
            return None
        base = f"base-{level}-{uuid.uuid4().hex}"
        with self._alone():
            state = self.log.state()
            if set(batches) - set(state.active):
                raise RuntimeError("another rewrite has replaced some of these batches")
            tables = sorted({t for b in batches for t in state.active[b]["tables"]})
            self._write_all(base, {t: change(t, self.partials(t, batches, state)) for t in tables})
            self._commit(base, batches)
        return base

    def _rewrite_sites(self, site_ids: DataFrame, change) -> str | None:
        """Write the files that hold some sites anew, through ``change(table, rows)``, and hide them.

        Which files those are is read from the site column alone, whose ranges Parquet knows; only names of files reach the driver.
        """
        base = f"base-1-{uuid.uuid4().hex}"
        wanted = site_ids.select("site_id").distinct()
        with self._alone():
            state = self.log.state()
            hidden: dict[str, dict[str, list[str]]] = {}
            shown = {table: rows for table in SCHEMAS if (rows := self.partials(table, state=state)).inputFiles()}
            if not shown:
                return None
            held = [
                rows.select("site_id", F.lit(table).alias("_table"), "batch", F.col("_metadata.file_name").alias("_file"))
                for table, rows in shown.items()
            ]  # one job looks through all tables
            found = reduce(DataFrame.unionByName, held).join(wanted, "site_id", "left_semi").select("_table", "batch", "_file").distinct().collect()
            for row in found:
                hidden.setdefault(row.batch, {}).setdefault(row._table, []).append(row._file)
            tables = {
                table: change(table, rows.where(F.col("_metadata.file_name").isin([r._file for r in found if r._table == table])))
                for table, rows in shown.items() if any(r._table == table for r in found)
            }
            if not tables:
                return None
            self._write_all(base, tables)
            self._commit(base, [], hidden)
        return base

    def _fold_partials(self, table: str, rows: DataFrame, now: int | None) -> DataFrame:
        if table == STATS:
            return rows.groupBy("site_id", "file_path", "day").agg(
                *[F.sum(c).alias(c) for c in ("lines", "events", "rejected")]
            )
        if table == FILES:
            return rows.groupBy("site_id", "lines", "digest").agg(*[F.min(c).alias(c) for c in ("file_path", "day")])
        if table == SEEN:  # a path keeps what it held last
            last = F.max_by(F.struct("site_id", "length", "modified", "day"), F.struct("day", "batch")).alias("_last")
            return rows.groupBy("file_path").agg(last).select("file_path", "_last.*")
        if table == PENDING:
            return rows.groupBy("site_id", "log", "lines", "digest").agg(F.min("day").alias("day"))
        if table == DETAIL:
            limits = self.options.cutoffs(now or 0)
            return rows if now is None else retention.retained_details(rows, **limits)
        spec = ROLLUPS[table]
        if "day" in spec.keys:
            oldest = "" if now is None else self._oldest_day(now)
            return R.merge(retention.retained_days(rows, oldest), spec)
        # day follows from the time key, so it only joins the grouping
        return rows.groupBy(*spec.keys, "day").agg(
            *[F.sum(c).alias(c) for c in spec.sums],
            *[F.hll_union_agg(c).alias(c) for c in spec.sketches],
        )

    def _oldest_day(self, now: int) -> str:
        zone = ZoneInfo(self.options.timezone)
        oldest = now - self.options.analytics_retention_days * 86400
        return datetime.fromtimestamp(oldest, zone).strftime("%Y-%m-%d")

    def compact(self, now: int | None = None, full: bool = False) -> str | None:
        """Fold the batches since the last compaction into one, one row per key.

        Work follows the new data, not the size of the store; ``full`` folds everything.
        Readers switch with a single commit. With ``now``, expired rows are left out.
        """
        active = self.active_batches()
        batches = active if full else [b for b in active if not b.startswith("base-")]
        return self._rewrite(batches, lambda table, rows: self._fold_partials(table, rows, now))

    def fold(self, limit: int = 32, now: int | None = None) -> int:
        """Fold where ``limit`` batches have gathered: new ones into one, ``limit`` such ones into one of the next level, and so on.

        Every row is rewritten once a level, and readers meet fewer than ``limit`` batches a level, however many were
        stored. Returns the rewrites made; none where another rewrite is at work.
        """
        made = 0
        while True:
            levels: dict[int, list[str]] = {}
            for batch in self.active_batches():
                level = batch.split("-")[1] if batch.startswith("base-") else "0"
                levels.setdefault(int(level) if level.isdecimal() else 1, []).append(batch)
            full = [level for level, names in levels.items() if len(names) >= limit]
            if not full:
                return made
            try:
                self._rewrite(levels[min(full)], lambda table, rows: self._fold_partials(table, rows, now), min(full) + 1)
            except RuntimeError:
                return made
            made += 1

    def merge_sites(self, mapping: DataFrame) -> str | None:
        """Fold duplicate sites (site_id, canonical_id) in every table; files that hold none of them stay as they are."""

        def change(table: str, rows: DataFrame) -> DataFrame:
            if table not in ROLLUPS:
                return merge_details(rows, mapping)
            merged = merge_rollup(rows, mapping, ROLLUPS[table])
            time_key = ROLLUPS[table].keys[1]
            return merged if time_key == "day" else merged.withColumn(
                "day", clock.local_day(time_key)
            )

        both = mapping.select(F.explode(F.array("site_id", "canonical_id")).alias("site_id"))
        return self._rewrite_sites(both, change)

    def drop_sites(self, site_ids: DataFrame) -> str | None:
        """Delete all rows of the given sites, so that their logs can be read again."""
        return self._rewrite_sites(site_ids, lambda table, rows: rows.join(site_ids, "site_id", "left_anti"))

    def reclaim(self, now: int, rollup_days: int | None = None, grace: int = 3600) -> int:
        """Delete folders that are unreachable: replaced batches, rewrites that failed, and days past retention.

        A replaced or failed folder stays while it is younger than ``grace`` seconds, or was replaced less long ago, as
        readers that began before may still use it.

        Rows of a day that is only partly expired are hidden by ``details`` and leave with a
        later call or compaction. Minute, crawler and sketch rollups stay unless ``rollup_days``
        is given. Only folder names are listed; no data is read. Returns the folders deleted.
        """
        limits = self.options.cutoffs(now)
        first_day = {
            DETAIL: str(date(1970, 1, 1) + timedelta(days=min(limits.values()) // 86400 - 1)),
            DIMENSION_DAY.name: self._oldest_day(now),
        }
        if rollup_days is not None:
            oldest = str(date(1970, 1, 1) + timedelta(days=now // 86400 - rollup_days))
            for spec in (METRIC_MINUTE, SPIDER_MINUTE, UNIQUE_HOUR):
                first_day[spec.name] = oldest
        state, settled, removed = self.log.state(), time.time() - grace, 0
        for table in SCHEMAS:
            for batch, written in self._folders(self.path(table), "batch=", times=True):
                folder = f"{self.path(table)}/batch={batch}"
                failed = batch.startswith("base-") and batch not in state.active and batch not in state.gone and written < settled
                if failed or batch not in state.active and state.gone.get(batch, settled) < settled:
                    removed += remove_path(self.spark, folder)
                elif table in first_day:
                    for day in self._folders(folder, "day="):
                        if day < first_day[table]:
                            removed += remove_path(self.spark, f"{folder}/day={day}")
        old = [batch for batch, at in state.gone.items() if at < settled]
        if old:
            self.log.commit({"forget": old})
        self.log.trim(settled)
        return removed

    def _folders(self, path: str, prefix: str, times: bool = False) -> list:
        """Names of sub-folders after ``prefix``, with the seconds of their last change on demand."""
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        system = target.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [(s.getPath().getName(), s.getModificationTime() / 1000) for s in system.listStatus(target)]
        found = [(n[len(prefix):], t) for n, t in found if n.startswith(prefix)]
        return found if times else [n for n, _ in found]
