"""A stream of the lines of logs that are still being written.

A log is a file ``x.log`` and what rotation makes of it (``x.log.1``, ``x.log-20260901.gz`` and so on). A file is known by its first line, so it may be
renamed, copied away or compressed; the offset of the stream has, for every file of every log, the position after its last whole line. A micro-batch is what lies between
two offsets: new whole lines of files that grew, whole files that are new, and the rest of a file that was rotated meanwhile. A file that
shrank begins anew. Ranges are cut into splits, so a backlog of any size is read by many tasks.

The driver looks at the folder's names, sizes and times, and at both ends of files that changed; tasks open the files themselves, through Arrow's
file systems, so the folder must be reachable from every worker (a shared mount, an object store). A task checks that the file still begins with the line it was planned
for and else finds it by that line under its new name; where it is gone altogether the micro-batch fails rather than losing lines. Lines without an end are not emitted until they have one.
Tar archives are left to ``logs.read_archives``.
"""

from __future__ import annotations

import fnmatch
import hashlib
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

FORMAT = "hitfold_follow"
SCHEMA = "file_path STRING, value STRING"
#: Bytes of a file that tell it from others, of a step backwards in search of the last line's end, of a split, and of a read.
HEAD, STEP, SPLIT, READ = 4096, 1 << 16, 64 << 20, 4 << 20
#: Position that stands for all of a compressed file.
WHOLE = -1
_NAME = re.compile(r"(.+\.log)(?:[.-].+)?")
_ARCHIVE = re.compile(r"\.(tar|tar\.gz|tgz)$", re.IGNORECASE)


def file_system(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder, and the folder's path in it."""
    plain = re.sub(r"^file:/*", "/", folder).rstrip("/")
    if "://" not in plain:
        return fs.LocalFileSystem(), plain
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", plain))


def is_gzip(path: str) -> bool:
    return path.lower().endswith(".gz")


def first_line(system: fs.FileSystem, path: str) -> str | None:
    """What a file is known by: a digest of its first line, or of as much of it as counts; None while it has no whole line."""
    with system.open_input_stream(path, compression="gzip" if is_gzip(path) else None) as stream:
        head = b""
        while len(head) < HEAD and (more := stream.read(HEAD - len(head))):
            head += more
    line, end, _ = head.partition(b"\n")
    if not end and len(head) < HEAD:
        return None
    return hashlib.sha256(line + end).hexdigest()[:24]


def last_end(system: fs.FileSystem, path: str, size: int) -> int:
    """The position after the last newline, 0 if there is none."""
    with system.open_input_file(path) as file:
        while size > 0:
            start = max(0, size - STEP)
            file.seek(start)
            if (found := file.read(size - start).rfind(b"\n")) >= 0:
                return start + found + 1
            size = start
    return 0


def members(system: fs.FileSystem, root: str, pattern: str) -> dict[str, list[fs.FileInfo]]:
    """The files of every log of a folder."""
    found: dict[str, list[fs.FileInfo]] = {}
    for info in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        match = _NAME.fullmatch(info.base_name)
        if info.type == fs.FileType.File and match and not _ARCHIVE.search(info.base_name) and fnmatch.fnmatchcase(match[1], pattern):
            found.setdefault(match[1], []).append(info)
    return found


@dataclass
class Range(InputPartition):
    """Lines that start from ``start`` on and before ``stop``, in the file of a log that begins with ``line``; ``begin`` is where some line starts at or before ``start``."""

    folder: str
    log: str
    line: str
    begin: int
    start: int
    stop: int


class FollowReader(DataSourceStreamReader):
    def __init__(self, folder: str, pattern: str, start: str):
        self.folder, self.pattern, self.begin = folder, pattern, start
        self.seen: dict[tuple, tuple[str, int] | None] = {}

    def _measured(self, system: fs.FileSystem, info: fs.FileInfo) -> tuple[str, int] | None:
        try:
            line = first_line(system, info.path) if info.size else None
            if line is None:
                return None
            return line, WHOLE if is_gzip(info.path) else last_end(system, info.path, info.size)
        except (FileNotFoundError, OSError):  # renamed meanwhile: the next look finds it
            return None

    def snapshot(self, current: bool = True) -> dict:
        """The position after the last whole line of each file, by log and first line."""
        system, root = file_system(self.folder)
        logs = members(system, root, self.pattern)
        todo = {(i.path, i.size, i.mtime_ns): i for files in logs.values() for i in files}
        new = {key: info for key, info in todo.items() if key not in self.seen}
        with ThreadPoolExecutor(16) as pool:
            measured = dict(zip(new, pool.map(lambda info: self._measured(system, info), new.values()), strict=True))
        # what could not be read is looked at again
        self.seen = {key: self.seen[key] if key in self.seen else measured[key] for key in todo if key in self.seen or measured[key]}
        out: dict[str, dict[str, int]] = {}
        for log, files in logs.items():
            for info in files:
                found = self.seen.get((info.path, info.size, info.mtime_ns))
                if found and (current or info.base_name != log):
                    held = out.setdefault(log, {})
                    held[found[0]] = max(found[1], held.get(found[0], WHOLE))
        return {"logs": out}

    def initialOffset(self) -> dict:
        return {"logs": {}} if self.begin == "earliest" else self.snapshot(self.begin == "latest")

    def latestOffset(self) -> dict:
        return self.snapshot()

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for log, files in end["logs"].items():
            known = start["logs"].get(log, {})
            for line, stop in files.items():
                at = known.get(line, 0)
                if at == WHOLE or at == stop:
                    continue
                if stop == WHOLE:
                    out.append(Range(self.folder, log, line, at, at, WHOLE))
                    continue
                at = at if at < stop else 0
                out += [Range(self.folder, log, line, at, k, min(k + SPLIT, stop)) for k in range(at, stop, SPLIT)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        system, root = file_system(partition.folder)
        name = quote(f"{partition.folder.rstrip('/')}/{partition.log}", safe="/:")
        path = self._place(system, root, partition)
        for data in _lines(system, path, partition):
            lines = data.split(b"\n")[:-1]
            try:
                values = pa.array(lines, pa.binary()).cast(pa.string())
            except pa.ArrowInvalid:
                values = pa.array([line.decode("utf-8", "replace") for line in lines])
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(lines), pa.string()), values], ["file_path", "value"])

    @staticmethod
    def _place(system: fs.FileSystem, root: str, wanted: Range) -> str:
        """Where the file lies now: the largest of those that begin with its line, a plain one before a compressed one."""
        files = members(system, root, "*").get(wanted.log, [])
        for info in sorted(files, key=lambda i: (is_gzip(i.path), i.base_name != wanted.log, -i.size)):
            try:
                if (is_gzip(info.path) or info.size >= wanted.stop) and first_line(system, info.path) == wanted.line:
                    return info.path
            except FileNotFoundError:
                continue
        raise FileNotFoundError(f"{wanted.log}: the file with lines {wanted.start} to {wanted.stop} is gone from {wanted.folder}")


def _lines(system: fs.FileSystem, path: str, part: Range) -> Iterator[bytes]:
    """Whole lines of a range, some at a time."""
    if is_gzip(path):
        stream, at = system.open_input_stream(path, compression="gzip"), 0
        while at < part.start and (skipped := len(stream.read(min(READ, part.start - at)))):
            at += skipped
    else:
        stream, at = system.open_input_file(path), part.start
        stream.seek(at)
    held, lead = b"", False
    with stream:
        if part.start > part.begin:  # a line that started before belongs to the split before
            if is_gzip(path):
                raise ValueError("a compressed file is not split")
            stream.seek(part.start - 1)
            at, lead = part.start - 1, True
        while data := stream.read(READ):
            held += data
            if lead:
                cut = held.find(b"\n")
                if cut < 0:
                    at, held = at + len(held), b""
                    continue
                at, held, lead = at + cut + 1, held[cut + 1 :], False
            if part.stop != WHOLE and at >= part.stop:
                return
            cut = held.rfind(b"\n") + 1
            if part.stop != WHOLE and at + cut >= part.stop:
                # the last line of the range is the one that ends at or after its last byte
                cut = held.find(b"\n", part.stop - at - 1) + 1
                yield held[:cut]
                return
            if cut:
                yield held[:cut]
                at, held = at + cut, held[cut:]


class FollowSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> FollowReader:
        start = self.options.get("start", "current")
        if start not in ("earliest", "current", "latest"):
            raise ValueError(f"start: {start!r}")
        return FollowReader(self.options["folder"], self.options.get("pattern", "*.log"), start)


def follow_lines(spark: SparkSession, folder: str, pattern: str = "*.log", start: str = "current") -> DataFrame:
    """New lines of the logs of a folder (``file_path`` is the log's, whatever rotation named its file).

    A stream that begins reads ``current`` files from their beginning, with ``earliest`` also what was rotated before, with ``latest`` only what comes.
    """
    spark.dataSource.register(FollowSource)
    return spark.readStream.format(FORMAT).option("folder", folder).option("pattern", pattern).option("start", start).load()
