"""Files, archives, the registry and CSV output."""

import gzip
import io
import os
import tarfile

import pytest
from pyspark.sql import functions as F

from hitfold.operators import parse
from hitfold.options import Options
from hitfold.sources import exports, logs, registry


def line(n, path="/"):
    return f'1.1.1.{n} - - [01/Sep/2026:10:20:30 +0800] "GET {path} HTTP/1.1" 200 1 "-" "x"\n'


def tar_bytes(mode, **members):
    buffer = io.BytesIO()
    with tarfile.open(fileobj=buffer, mode=mode) as archive:
        for name, text in members.items():
            info = tarfile.TarInfo(name)
            info.size = len(text.encode())
            archive.addfile(info, io.BytesIO(text.encode()))
    return buffer.getvalue()


def history(folder):
    (folder / "site.log").write_text(line(1))
    (folder / "site.log-1").write_text(line(2))
    (folder / "site.log-2.gz").write_bytes(gzip.compress(line(3).encode()))
    (folder / "site.log-3.tar.gz").write_bytes(tar_bytes("w:gz", a=line(4), b=line(5).rstrip("\n")))
    (folder / "site.log-4.tar").write_bytes(tar_bytes("w", c=line(6) + "broken\n"))
    (folder / "other.log").write_text(line(9))


def test_history_reads_every_form(spark, tmp_path):
    history(tmp_path)
    events = parse.parse_lines(logs.read_history(spark, str(tmp_path / "site.log")))
    addresses = sorted(r.remote_addr or "" for r in events.collect())
    assert addresses == ["", "1.1.1.1", "1.1.1.2", "1.1.1.3", "1.1.1.4", "1.1.1.5", "1.1.1.6"]


def test_old_rotated_files_are_skipped_but_not_the_current_one(spark, tmp_path):
    history(tmp_path)
    for name in ("site.log", "site.log-1", "site.log-3.tar.gz"):
        os.utime(tmp_path / name, (1000, 1000))
    lines = logs.read_history(spark, str(tmp_path / "site.log"), since=2000)
    hosts = sorted(r.value[:7] for r in lines.where("value != 'broken'").collect())
    assert hosts == ["1.1.1.1", "1.1.1.3", "1.1.1.6"]


def test_archives_of_other_file_systems_are_read_by_spark(spark, tmp_path):
    history(tmp_path)
    files = logs.list_files(spark, str(tmp_path), logs.ARCHIVE_GLOB)
    near, far = (sorted(r.value for r in logs.read_archives(files, local).collect()) for local in (logs.LOCAL, "^none:"))
    assert near and near == far


def test_only_newlines_end_a_line(spark, tmp_path):
    (tmp_path / "x.log").write_bytes(b"a\rb\nc\xff\n")
    values = [r.value for r in logs.read_lines(spark, str(tmp_path / "x.log")).collect()]
    assert values == ["a\rb", "c�"]


def test_modified_after_prunes_files(spark, tmp_path):
    history(tmp_path)
    os.utime(tmp_path / "other.log", (1000, 1000))
    names = logs.list_files(spark, str(tmp_path), "*.log", 2000)
    assert [r.path.rsplit("/", 1)[1] for r in names.collect()] == ["site.log"]


def test_lines_find_their_site(spark, tmp_path):
    history(tmp_path)
    sites = spark.createDataFrame([(1, f"{tmp_path}/site.log"), (2, f"{tmp_path}/other.log"), (3, f"{tmp_path}/si")],
                                  "id bigint, log_path string")
    lines = logs.read_lines(spark, [str(tmp_path / n) for n in ("site.log", "site.log-1", "other.log")])
    owned = registry.with_site(lines, sites).groupBy("site_id").count().collect()
    assert {r.site_id: r["count"] for r in owned} == {1: 2, 2: 1}


def test_registry_rows_and_orphans(spark, tmp_path):
    rows = spark.createDataFrame([(7, " example.test ", "/www"), (0, "zero", ""), (8, "", "/x")], "id bigint, name string, path string")
    known = registry.registered(rows, str(tmp_path))
    only = known.first()
    assert known.count() == 1 and only.log_path == f"{tmp_path}/example.test.log"
    for name in ("example.test.log", "panel.log", "proxy.log", "x.error.log", "access.log", "notes.txt"):
        (tmp_path / name).write_text("x")
    files = logs.list_files(spark, str(tmp_path))
    found = {r.panel_site_id: r.name for r in registry.orphans(files, known).collect()}
    assert found == {-1: "panel", -2: "proxy"}


def test_csv_files(spark, tmp_path):
    rows = spark.createDataFrame([("=cmd", 'say "hi", ok', None, -5)], "a string, b string, c string, d int")
    exports.write_csv(exports.guarded(rows).coalesce(1), str(tmp_path / "out"), quote_all=True)
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("*.csv")))
    assert text == '"a","b","c","d"\n"\'=cmd","say ""hi"", ok","","\'-5"\n'


def test_export_has_the_ten_columns(spark):
    item = {"timestamp": 1788229230, "remote_addr": "1.1.1.1", "method": "GET", "uri": "=x", "status": 200, "body_bytes": 5,
            "browser": "Edge", "system": "Windows", "device": "Desktop", "spider": ""}
    row = exports.request_rows(spark.createDataFrame([item]), "Asia/Shanghai").first()
    assert tuple(row) == ("2026-09-01 10:20:30", "1.1.1.1", "GET", "'=x", "200", "5", "Edge", "Windows", "Desktop", "")
    assert row.__fields__ == list(exports.REQUEST_HEADINGS)


def test_tail_is_a_time_limit(spark):
    df = spark.range(10).select(F.col("id").alias("timestamp"))
    assert logs.tail(df, 7).count() == 3


def test_options_are_validated():
    many = tuple(f"/{i}" for i in range(200))
    o = Options(excluded_paths=many, raw_retention_days=400, error_retention_days=9999, analytics_retention_days=1)
    assert o.excluded_paths == many
    assert o.cutoffs(10**9) == {"raw_before": 10**9 - 400 * 86400, "error_before": 10**9 - 9999 * 86400}
    for wrong in ({"hll_precision": 99}, {"raw_retention_days": "x"}, {"error_retention_days": 0}, {"excluded_paths": ("/a", "b")}):
        with pytest.raises(ValueError):
            Options(**wrong)
