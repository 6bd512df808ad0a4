"""Access-log lines from current, rotated, compressed and archived files.

All readers return ``file_path`` and ``value``. Lines end at ``\\n`` only.
Plain files split into many tasks; a gzip or tar file is one task, as its format demands.
"""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator, Sequence
from datetime import datetime, timezone
from itertools import groupby
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hitfold.sources.streams import chunks, ordered_lines

# File endings read as tar archives.
ARCHIVES = (".tar", ".tar.gz", ".tgz")
ARCHIVE_GLOB = "*.{tar,tar.gz,tgz}"
_BATCH_LINES = 20_000
LINE_SCHEMA = "file_path STRING, value STRING"
# Endings of files that are read by one task each.
PACKED = (".gz", ".tgz", ".tar")


def iso(ts: int | float) -> str:
    """Epoch seconds in the form of the ``modifiedAfter`` option (session zone UTC)."""
    return datetime.fromtimestamp(ts, timezone.utc).strftime("%Y-%m-%dT%H:%M:%S")


def _with_path(df: DataFrame) -> DataFrame:
    return df.select(F.col("_metadata.file_path").alias("file_path"), "value")


def is_archive(path: Column) -> Column:
    return path.rlike(r"(?i)\.(tar|tar\.gz|tgz)$")


def read_lines(
    spark: SparkSession, paths: str | Sequence[str], modified_after: float | None = None
) -> DataFrame:
    """Plain and gzip files. ``modified_after`` prunes files that cannot hold recent lines."""
    reader = spark.read.option("lineSep", "\n")
    if modified_after:
        reader = reader.option("modifiedAfter", iso(modified_after)).option("timeZone", "UTC")
    return _with_path(reader.text([paths] if isinstance(paths, str) else list(paths)))


def list_files(
    spark: SparkSession, folder: str, pattern: str = "*", modified_after: float | None = None
) -> DataFrame:
    """Files of a folder: path, length, modificationTime; contents are not read.

    Spark leaves out empty files.
    """
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern)
    if modified_after:
        reader = reader.option("modifiedAfter", iso(modified_after)).option("timeZone", "UTC")
    return reader.load(folder).select("path", "length", "modificationTime")


def archive_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Lines of every file in each archive, streamed from a path that the worker can open."""
    for batch in batches:
        for name, path in zip(batch["file_path"], batch["path"], strict=True):
            with open("/" + path.removeprefix("file:").lstrip("/"), "rb") as raw:
                yield from _members(name, raw)


def _members(name: str, raw) -> Iterator[pd.DataFrame]:
    with tarfile.open(fileobj=raw, mode="r|*") as archive:
        for member in archive:
            lines = archive.extractfile(member) if member.isfile() else None
            if lines is not None:
                yield from _line_batches(name, lines)


class _Pieces(io.RawIOBase):
    """A file that is read forward from pieces as they come."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held = pieces, b""

    def readable(self) -> bool:
        return True

    def readinto(self, target) -> int:
        if not self.held:
            self.held = next(self.pieces, b"")
        n = min(len(target), len(self.held))
        target[:n], self.held = self.held[:n], self.held[n:]
        return n


def streamed_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of every file in archives whose bytes come from Spark's readers, see ``streams``."""
    for name, pieces in groupby(chunks(batches), key=lambda piece: piece[0]):
        for lines in _members(name, io.BufferedReader(_Pieces(data for _, data in pieces))):
            yield pa.RecordBatch.from_pandas(lines, preserve_index=False)


def _line_batches(path: str, content) -> Iterator[pd.DataFrame]:
    lines: list[str] = []
    for line in content:
        lines.append(line.removesuffix(b"\n").decode("utf-8", "replace"))
        if len(lines) >= _BATCH_LINES:
            yield pd.DataFrame({"file_path": path, "value": lines})
            lines = []
    if lines:
        yield pd.DataFrame({"file_path": path, "value": lines})


LOCAL = "^(file:)?/"


def read_archives(files: DataFrame, local: str = LOCAL) -> DataFrame:
    """Lines of the tar archives named in ``path`` (as ``file_path``, where there is one), one archive per task.

    Paths that match ``local`` must be the same on every worker, which opens them. Archives of other file systems are opened by Spark's
    text reader and come to their task as a stream, so that their size does not matter either.
    """
    name = F.col("file_path" if "file_path" in files.columns else "path").alias("file_path")
    paths = files.where(is_archive(F.col("path"))).select("path", name)
    lines = paths.where(F.col("path").rlike(local)).repartition("path").mapInPandas(archive_lines, LINE_SCHEMA)
    far = [row.path for row in paths.where(~F.col("path").rlike(local)).toLocalIterator()]  # names only
    if not far:
        return lines
    return lines.unionByName(ordered_lines(files.sparkSession, far).mapInArrow(streamed_lines, LINE_SCHEMA))


def read_history(
    spark: SparkSession, log_path: str, since: float | None = None
) -> DataFrame:
    """The current file of a log, its rotated files and their archives.

    Rotated files last changed before ``since`` are skipped; the current file never is. Order does
    not matter, as every rollup merges in any order.
    """
    folder, _, name = log_path.rpartition("/")
    path = F.col("_metadata.file_path")
    wanted = ~is_archive(path)
    current = F.col("_metadata.file_name") == quote(name)
    if since:
        wanted = wanted & (current | (F.col("_metadata.file_modification_time") >= F.timestamp_seconds(F.lit(int(since)))))
    lines = _with_path(_glob(spark, folder, f"{name}*").where(wanted))
    files = list_files(spark, folder, f"{name}*", since)
    return lines.unionByName(read_archives(files))


def _glob(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """Text of the files of a folder. A filter on ``_metadata`` leaves files out before they are opened."""
    reader = spark.read.option("lineSep", "\n").option("pathGlobFilter", pattern).option("ignoreMissingFiles", "true")
    return reader.text(folder)


# A rotated file's name goes on after the log's: ``x.log.1``, ``x.log-20260901.gz``.
CLOSED = r"\.log[.-][^/]+$"


def read_closed(
    spark: SparkSession, folder: str, pattern: str = "*.log[.-]*", since: float | None = None
) -> DataFrame:
    """Lines of the rotated files of a folder, plain, gzip or in archives; files still written to are left out."""
    path = F.col("_metadata.file_path")
    wanted = ~is_archive(path) & path.rlike(CLOSED)
    if since:
        wanted = wanted & (F.col("_metadata.file_modification_time") >= F.timestamp_seconds(F.lit(int(since))))
    lines = _with_path(_glob(spark, folder, pattern).where(wanted))
    return lines.unionByName(read_archives(list_files(spark, folder, pattern, since)))


def read_named(spark: SparkSession, folder: str, pattern: str, names: list[str]) -> DataFrame:
    """Lines of some files of a folder, by their locations as Spark writes them; files that are gone meanwhile are left out."""
    path = F.col("_metadata.file_path")
    lines = _with_path(_glob(spark, folder, pattern).where(~is_archive(path) & path.isin(names)))
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return lines.unionByName(read_archives(files.where(path.isin(names)).select(path.alias("file_path"), "path")))


def dealt(lines: DataFrame) -> DataFrame:
    """Lines of packed files, each unpacked by one task, over all tasks, so that what follows takes no longer than for plain files."""
    return lines.withColumn("_n", F.monotonically_increasing_id()).repartition("_n").drop("_n")


def contents(lines: DataFrame) -> DataFrame:
    """What each file holds, whatever its name and compression: (file_path, lines, digest)."""
    digest = F.sum(F.xxhash64("value").cast("decimal(38,0)")).cast("string")
    return lines.groupBy("file_path").agg(F.count("*").alias("lines"), digest.alias("digest"))


def tail(events: DataFrame, since: int) -> DataFrame:
    """Recent events only. A distributed scan has no last N bytes, so the tail is a time limit."""
    return events.where(F.col("timestamp") >= since)


def stream_lines(
    spark: SparkSession, folder: str, pattern: str = "*", files_per_trigger: int = 1000,
    from_end: float | None = None,
) -> DataFrame:
    """New log files as they appear; the checkpoint remembers which were read.

    ``from_end`` skips files that existed before the given time.
    """
    reader = (
        spark.readStream.option("lineSep", "\n")
        .option("maxFilesPerTrigger", files_per_trigger)
        .option("pathGlobFilter", pattern)
    )
    if from_end:
        reader = reader.option("modifiedAfter", iso(from_end)).option("timeZone", "UTC")
    return _with_path(reader.text(folder))


def stream_messages(
    spark: SparkSession, folder: str | None = None, kafka: dict[str, str] | None = None,
    files_per_trigger: int = 1000, offsets_per_trigger: int | None = None, from_end: bool = True,
) -> DataFrame:
    """Live messages (one per request) from Kafka, or from files that a syslog relay lands.

    A micro-batch takes all waiting Kafka messages unless ``offsets_per_trigger`` bounds it.
    """
    if kafka is not None:
        reader = (
            spark.readStream.format("kafka")
            .option("startingOffsets", "latest" if from_end else "earliest")
            .options(**kafka)
        )
        if offsets_per_trigger is not None:
            reader = reader.option("maxOffsetsPerTrigger", offsets_per_trigger)
        return reader.load().select(F.col("value").cast("string").alias("value"))
    reader = spark.readStream.option("lineSep", "\n").option("maxFilesPerTrigger", files_per_trigger)
    return reader.text(folder)
