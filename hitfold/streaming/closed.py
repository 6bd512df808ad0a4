"""Rotated log files, each loaded once, whatever rotates meanwhile.

A load has three steps. *Listing* drops files that lie as they lay when they were last read (path, length, time of change, site). *Staging* parses what is left
into the shared folder with a hash a line; files that may only have been moved or compressed (of a length that the site had before, or packed) are hashed before, and
those that the store holds are not parsed again. *Committing* lists the files again and keeps those that did not change since the
first listing, so what was staged is what they hold; it tells by the staged hashes which of them are new and folds their staged rows into one batch. A file that was
renamed or rotated away in between is left to the next load, which finds it under its new name.

A file is known by its site and what it holds (number and sum of hashes of its lines), so it may change its name or be compressed. Files of no site are
counted once for each log and content as rejected, and load when their site is registered, which takes them off that count.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitfold.operators import parse as P
from hitfold.session import remove_path, stored
from hitfold.sources import logs, registry
from hitfold.store import FILES, PENDING, SEEN, STATS, Store

#: Files of one batch. A load goes on with further batches until no file is left.
FILES_A_BATCH = 10_000
#: Stands for no site in stored tables.
NO_SITE = 0
_LISTED = "file_path STRING, path STRING, length BIGINT, modified BIGINT"


def log_of(path: Column) -> Column:
    """The name of the log a rotated file belongs to: the path without what rotation appended."""
    return F.regexp_replace(path, r"(\.log)[.-][^/]*$", "$1")


def listing(store: Store, folder: str, pattern: str) -> DataFrame:
    """Rotated files of a folder as they lie now; contents are not read."""
    files = store.spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    named = files.select(
        F.col("_metadata.file_path").alias("file_path"), "path", "length", F.unix_millis("modificationTime").alias("modified")
    )
    return named.where(F.col("path").rlike(logs.CLOSED) | logs.is_archive(F.col("path")))


@dataclass
class Load:
    """One batch of a load, step by step; ``load_closed`` runs all."""

    store: Store
    sites: DataFrame
    folder: str
    batch: str
    pattern: str = "*.log[.-]*"
    since: int = 0
    detail_since: int = 0
    error_since: int = 0

    def __post_init__(self):
        self.paths: list[str] = []
        self.listed: DataFrame | None = None
        self.staged: DataFrame | None = None

    def list(self) -> bool:
        """Find up to ``FILES_A_BATCH`` files that changed since they were read; whether there are any."""
        now = registry.with_site(listing(self.store, self.folder, self.pattern), self.sites)
        now = now.withColumn("site_id", F.coalesce("site_id", F.lit(NO_SITE)))
        seen = self.store.partials(SEEN).select("file_path", "length", "modified", "site_id")
        changed = now.join(seen, ["file_path", "length", "modified", "site_id"], "left_anti")
        self.listed, self.paths = stored(changed.orderBy("file_path").limit(FILES_A_BATCH), "listed")
        return not self.listed.isEmpty()

    def stage(self) -> None:
        """Parse the listed files. Lines of files without a site, and of files that the store holds under other names, are only hashed."""
        spark = self.store.spark
        read = lambda names: logs.read_named(spark, self.folder, self.pattern, names)
        hashed = lambda lines: lines.withColumn("_hash", F.xxhash64("value"))
        packed = lambda name: name.lower().endswith(logs.PACKED)
        site = self.listed.select("file_path", "site_id")
        before = self.store.partials(SEEN).select("site_id", "length").distinct().withColumn("_before", F.lit(True))
        rows = (
            self.listed.join(before, ["site_id", "length"], "left")
            .select("file_path", (F.col("site_id") == NO_SITE).alias("loose"), F.col("_before").isNotNull().alias("likely")).collect()
        )  # at most FILES_A_BATCH
        first = [r.file_path for r in rows if r.loose or r.likely or packed(r.file_path)]
        counted, other = stored(self._contents(hashed(read(first))), "files")
        known = self.store.partials(FILES).select("site_id", "lines", "digest")
        held = {r.file_path for r in counted.join(site, "file_path").join(known, ["site_id", "lines", "digest"], "left_semi").select("file_path").collect()}
        todo = [r.file_path for r in rows if not r.loose and r.file_path not in held]
        lines = read([name for name in todo if not packed(name)])
        if wrapped := [name for name in todo if packed(name)]:
            lines = lines.unionByName(logs.dealt(read(wrapped)))
        judged = P.judge(P.parse_lines(hashed(lines).join(F.broadcast(site), "file_path")), self.store.options, self.since)
        self.staged, path = stored(self.store.enriched(self.batch, judged), "events")
        only = [r.file_path for r in rows if r.loose] + sorted(held)
        self.counted = counted.where(F.col("file_path").isin(only))
        self._scratch = [self.paths, path, other]

    @staticmethod
    def _contents(rows: DataFrame) -> DataFrame:
        digest = F.sum(F.col("_hash").cast("decimal(38,0)")).cast("string")
        return rows.groupBy("file_path").agg(F.count("*").alias("lines"), digest.alias("digest"))

    def commit(self) -> tuple[int, int]:
        """Fold what is new into the store. Returns the files loaded, and those that were read and are now known."""
        store, day = self.store, F.current_date().alias("day")
        now = listing(store, self.folder, self.pattern).select("file_path", "length", "modified")
        still, path = stored(self.listed.join(now, ["file_path", "length", "modified"], "left_semi"), "still")
        try:
            parsed = lambda rows, is_it: rows.withColumn("parsed", F.lit(is_it))
            held = parsed(self._contents(self.staged), True).unionByName(parsed(self.counted, False))
            told = still.select("file_path", "site_id", "length", "modified").join(held, "file_path", "left")
            told = told.withColumns({"lines": F.coalesce("lines", F.lit(0)), "digest": F.coalesce("digest", F.lit("0"))})
            known = store.partials(FILES).select("site_id", "lines", "digest")
            # a file that was only hashed and left the store meanwhile (its site was dropped) is left to the next load
            left = told.where((F.col("site_id") != NO_SITE) & ~F.col("parsed")).join(known, ["site_id", "lines", "digest"], "left_anti")
            told, more = stored(told.join(left.select("file_path"), "file_path", "left_anti"), "told")
            self._scratch.append(more)
            fresh = (
                told.where((F.col("site_id") != NO_SITE) & F.col("parsed")).join(known, ["site_id", "lines", "digest"], "left_anti")
                .groupBy("site_id", "lines", "digest").agg(F.min("file_path").alias("file_path"))
            )
            fresh, last = stored(fresh, "fresh")
            self._scratch.append(last)
            loaded, settled = fresh.count(), told.count()
            if settled:
                loose = told.where((F.col("site_id") == NO_SITE) & (F.col("lines") > 0))
                rows = self.staged.join(fresh.select("file_path"), "file_path", "left_semi").drop("_hash")
                tables = {
                    FILES: fresh.select("site_id", "lines", "digest", "file_path", day),
                    SEEN: told.select("site_id", "file_path", "length", "modified", day),
                    PENDING: loose.select("site_id", log_of(F.col("file_path")).alias("log"), "lines", "digest", day).distinct(),
                }
                if loaded:
                    store.ingest_enriched(self.batch, rows, self.detail_since, self.error_since, more=tables)
                else:
                    store.append(self.batch, tables)
            return loaded, settled
        finally:
            remove_path(store.spark, path)
            self.clear()

    def clear(self) -> None:
        for path in getattr(self, "_scratch", [self.paths]):
            remove_path(self.store.spark, path)


def load_closed(
    store: Store, sites: DataFrame, folder: str, batch: str, pattern: str = "*.log[.-]*",
    since: int = 0, detail_since: int = 0, error_since: int = 0, between: Callable[[], None] = lambda: None,
) -> int:
    """Load the rotated files of a folder that were not loaded before; the number of files loaded.

    Names of batches follow ``batch``; one that is in use is passed over, so a load may be repeated under its name. ``between`` is called after the listing and after the
    staging of each batch, where a rotation may fall.
    """
    total, number = 0, 0
    while True:
        state = store.log.state()
        while (name := f"{batch}.{number}" if number else batch) in state.active or name in state.named:
            number += 1
        load = Load(store, sites, folder, name, pattern, since, detail_since, error_since)
        if not load.list():
            load.clear()
            return total
        between()
        load.stage()
        between()
        loaded, settled = load.commit()
        total += loaded
        if not settled:  # everything moved meanwhile
            return total


def progress(store: Store) -> DataFrame:
    """Lines, events and rejected lines of every site over all batches; site 0 has the lines that belong to none.

    Files of no site count once for each log and content while no site has loaded them.
    """
    owned = store.partials(FILES).select(log_of(F.col("file_path")).alias("log"), "digest", "lines").distinct()
    waiting = store.partials(PENDING).select("log", "digest", "lines").distinct().join(owned, ["log", "digest", "lines"], "left_anti")
    none = F.lit(NO_SITE).cast("bigint")
    counts = waiting.select(none.alias("site_id"), "lines", none.alias("events"), F.col("lines").alias("rejected"))
    rows = store.partials(STATS).select("site_id", "lines", "events", "rejected").unionByName(counts)
    return rows.groupBy("site_id").agg(*[F.sum(c).alias(c) for c in ("lines", "events", "rejected")])
