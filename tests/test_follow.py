"""Logs that grow, rotate, are copied away, truncated and compressed while they are followed."""

import gzip
import shutil

import pytest

from hitfold.sources import follow
from hitfold.sources.follow import FollowReader


class Stream:
    """A stream's offsets without its engine: each call gives the values of one micro-batch."""

    def __init__(self, folder, start="earliest"):
        self.reader = FollowReader(str(folder), "*.log", start)
        self.at = self.reader.initialOffset()

    def __call__(self, during=lambda: None):
        end = self.reader.latestOffset()
        parts = self.reader.partitions(self.at, end)
        during()
        values = [v for p in parts for b in self.reader.read(p) for v in b.column(1).to_pylist()]
        self.at = end
        return values


def test_append_rotate_truncate_compress(tmp_path):
    log, stream = tmp_path / "a.log", Stream(tmp_path)
    log.write_bytes(b"a1\na2\nhal")
    assert stream() == ["a1", "a2"] and stream() == []
    log.write_bytes(b"a1\na2\nhalf\na\xff\n")
    assert stream() == ["half", "a�"]
    with log.open("ab") as out:
        out.write(b"late\n")
    log.rename(tmp_path / "a.log.1")
    log.write_bytes(b"b1\n")
    assert sorted(stream()) == ["b1", "late"]
    with (tmp_path / "a.log.1").open("ab") as out:  # the writer had it still open
        out.write(b"later\n")
    assert stream() == ["later"]
    (tmp_path / "a.log.1").rename(tmp_path / "a.log.2")
    with gzip.open(tmp_path / "a.log.2.gz", "wb") as out:
        out.write((tmp_path / "a.log.2").read_bytes() + b"last\n")
    (tmp_path / "a.log.2").unlink()
    log.rename(tmp_path / "a.log.1")
    log.write_bytes(b"c1\nc2\n")
    assert sorted(stream()) == ["c1", "c2", "last"] and stream() == []
    shutil.copy(log, tmp_path / "a.log.0")  # copied away, then truncated
    log.write_bytes(b"")
    assert stream() == []
    log.write_bytes(b"d\n")
    assert stream() == ["d"]
    log.write_bytes(b"d\nd2\n")
    assert stream() == ["d2"]
    log.write_bytes(b"d\n")  # shrank
    assert stream() == ["d"]


def test_two_rotations_between_looks(tmp_path):
    log, stream = tmp_path / "a.log", Stream(tmp_path)
    log.write_text("a\n")
    assert stream() == ["a"]
    for name, text in (("b", "b\n"), ("c", "c\n")):
        for k in (2, 1):
            if (tmp_path / f"a.log.{k}").exists():
                (tmp_path / f"a.log.{k}").rename(tmp_path / f"a.log.{k + 1}")
        log.rename(tmp_path / "a.log.1")
        log.write_text(text)
    assert sorted(stream()) == ["b", "c"]


@pytest.mark.parametrize("compress", [False, True])
def test_rotation_between_plan_and_read(tmp_path, compress):
    log, stream = tmp_path / "a.log", Stream(tmp_path)
    log.write_text("a1\na2\n")

    def rotate():
        log.rename(tmp_path / "a.log.1")
        log.write_text("b1\n")
        if compress:
            with gzip.open(tmp_path / "a.log.1.gz", "wb") as out:
                out.write((tmp_path / "a.log.1").read_bytes())
            (tmp_path / "a.log.1").unlink()

    assert stream(rotate) == ["a1", "a2"]
    assert stream() == ["b1"]
    log.write_text("b1\nb2\n")
    with pytest.raises(FileNotFoundError, match="gone"):
        stream(log.unlink)


def test_where_a_stream_begins(tmp_path):
    (tmp_path / "a.log").write_text("new\n")
    (tmp_path / "a.log.1").write_text("old\n")
    (tmp_path / "a.log.2.gz").write_bytes(gzip.compress(b"older\n"))
    (tmp_path / "notes.txt").write_text("no\n")
    (tmp_path / "a.log.tar").write_text("no\n")
    streams = {start: Stream(tmp_path, start) for start in ("earliest", "current", "latest")}
    (tmp_path / "a.log").write_text("new\nnewer\n")
    assert {k: sorted(s()) for k, s in streams.items()} == {
        "earliest": ["new", "newer", "old", "older"], "current": ["new", "newer"], "latest": ["newer"]}


@pytest.mark.parametrize("split", [1, 2, 3, 7, 50])
def test_splits_share_out_all_lines(tmp_path, monkeypatch, split):
    monkeypatch.setattr(follow, "SPLIT", split)
    monkeypatch.setattr(follow, "READ", 3)
    lines = ["", "x", "", "a longer line", "yy", "", "z" * 20]
    (tmp_path / "a.log").write_text("\n".join(lines) + "\nrest")
    assert Stream(tmp_path)() == lines


def test_long_first_lines(tmp_path, monkeypatch):
    monkeypatch.setattr(follow, "HEAD", 8)
    monkeypatch.setattr(follow, "STEP", 4)
    log, stream = tmp_path / "a.log", Stream(tmp_path)
    log.write_text("0123456")
    assert stream() == []
    log.write_text("0123456789abcdef\nmore\nunfinished end")
    assert stream() == ["0123456789abcdef", "more"]
    log.rename(tmp_path / "a.log.1")
    log.write_text("0\n")
    assert stream() == ["0"]
