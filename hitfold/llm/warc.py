"""WARC archives of pages: written with revisits and segments, read back record by record, payloads put together and verified.

*Writing.* Every page is a ``response`` record whose block is an HTTP message in chunked transfer framing. A block above ``SEGMENT`` bytes is cut: the
response holds the first segment, ``continuation`` records the others, each with the origin's id and a segment number, the last with the
total length. Of pages with equal payloads of at least ``REVISIT_LEAST`` bytes, that with the smallest id is the response, the others are ``revisit`` records
that refer to it. Spark's text writer makes the files, records ended by CRLF CRLF, one gzip stream a file, so any file system Spark writes to can hold them.

*Reading.* A task gets the bytes of a file in order (``hitfold.sources.streams``) and cuts them into records by their lengths, never by looking for separators. Segments are grouped by
the id of their origin (a group is one record), put in order of their numbers, checked for gaps and against the total length, and decoded like whole blocks. A revisit takes
length and page from the response it names.

What does not hold together is not dropped: ``problem`` names what is wrong, null where nothing is.

Edge rows: null html is an empty payload; a null url leaves out the header; line ends in a url are percent-encoded. Pages without an id are responses, or revisits where a page with an id has
the payload. Rows that repeat id and payload are all responses when theirs is the smallest id; they share a record id. Payloads of any length are written and read whole, long ones in segments; other columns are not read.
An empty table is an archive without records, which gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hitfold.llm.common import column_of, partitions, written
from hitfold.session import scratch_path
from hitfold.sources.streams import chunks, ordered_lines

#: Bytes of a segment and of a chunk, and the least payload that is worth a revisit.
SEGMENT, CHUNK, REVISIT_LEAST = 16_384, 4_096, 100
#: Bytes of blocks that a task holds before it hands them on.
HAND_ON = 4 << 20
DATE = "1970-01-01T00:00:00Z"
# The profile of revisits and the ends of lines and records.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


# --- joins with hot keys -------------------------------------------------------------------------


def join_counted(rows: DataFrame, held: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` left joined with ``held`` by ``key``, where ``held`` has each key once and, as ``times``, the rows that have it.

    Keys of more than a quarter of a task's share of ``total`` rows are at most four a task, so they are broadcast; their rows then need no other partner and
    are spread by their place. No task meets more rows of a key than that.
    """
    share = max(1, total // (4 * partitions(rows.sparkSession)))
    names = [c for c in held.columns if c not in (key, "times")]
    hot = held.filter(F.col("times") > share).select(F.col(key), F.struct(*names).alias("__llm_hot"))
    rest = held.filter(F.col("times") <= share).select(F.col(key).alias("__llm_free"), F.struct(*names).alias("__llm_rest"))
    alone = F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string"))
    near = rows.join(F.broadcast(hot), key, "left").withColumn("__llm_free", F.when(F.col("__llm_hot").isNull() & F.col(key).isNotNull(), F.col(key)).otherwise(alone))
    found = F.coalesce("__llm_hot", "__llm_rest")
    return near.join(rest, "__llm_free", "left").select(*rows.columns, *[found[c].alias(c) for c in names])


# --- writing -------------------------------------------------------------------------------------


def _headers(*pairs: tuple[str, Column | str | None]) -> Column:
    """Header lines; those whose value is null are left out."""
    lines = [F.lit("WARC/1.1" + CRLF)]
    for name, value in pairs:
        value = F.lit(value) if isinstance(value, str) else value
        lines.append(F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF)), F.lit("")))
    return F.concat(*lines, F.lit(CRLF))


def record_id(page_id: Column, digest: Column) -> Column:
    """The id of a page's record, from its id and what it holds."""
    h = F.sha2(F.concat(F.coalesce(page_id.cast("string"), F.lit("-")), F.lit(" "), digest), 256)
    cut = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), cut(1, 8), F.lit("-"), cut(9, 4), F.lit("-8"), cut(14, 3), F.lit("-8"), cut(18, 3), F.lit("-"), cut(21, 12), F.lit(">"))


def chunked(payload: str, size: int) -> Column:
    """The binary column ``payload`` in chunked transfer framing, as bytes in a string."""
    n = F.octet_length(payload)
    starts = F.filter(F.sequence(F.lit(0), F.expr(f"int((octet_length({payload}) - 1) div {size})")), lambda i: i * size < n)

    def piece(i: Column) -> Column:
        data = F.substring(F.col(payload), i * size + 1, F.lit(size))
        return F.concat(F.lower(F.hex(F.octet_length(data))), F.lit(CRLF), data.cast("string"), F.lit(CRLF))

    return F.concat(F.array_join(F.transform(starts, piece), ""), F.lit("0\r\n\r\n"))


def decided(pages: DataFrame, least: int = REVISIT_LEAST) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): ``refers_to`` is the page whose response a revisit repeats."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload")
    ).withColumn("digest", F.sha2("payload", 256))
    held = rows.filter(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("times"))
    held = written(held.filter("times > 1 AND first IS NOT NULL"), "warc-repeats")
    total = held.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0]
    again = F.when(F.col("page_id").isNull() | (F.col("page_id") > F.col("first")), F.col("first"))
    return join_counted(rows, held, "digest", total).select("page_id", "url", "payload", "digest", again.alias("refers_to"))


def records(pages: DataFrame, segment: int = SEGMENT, chunk: int = CHUNK, date: str = DATE) -> DataFrame:
    """(value): one record a row, its bytes in a string, without the end of the record."""
    rows = decided(pages).withColumn("__llm_block", F.when(F.col("refers_to").isNull(), F.concat(F.lit(HTTP), chunked("payload", chunk))).otherwise(F.lit("")).cast("binary"))
    total = F.octet_length("__llm_block")
    parts = F.transform(F.sequence(F.lit(0), F.expr(f"int(greatest(octet_length(__llm_block) - 1, 0) div {segment})")), lambda i: F.substring(F.col("__llm_block"), i * segment + 1, F.lit(segment)))
    cut = rows.select("page_id", "url", "digest", "refers_to", total.alias("total"), F.posexplode(parts).alias("place", "piece"))
    many, first, last = F.col("total") > segment, F.col("place") == 0, (F.col("place") + 1) * segment >= F.col("total")
    own = record_id(F.col("page_id"), F.col("digest"))
    revisit = F.col("refers_to").isNotNull()
    target = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    head = _headers(
        ("WARC-Type", F.when(revisit, "revisit").when(first, "response").otherwise("continuation")),
        ("WARC-Record-ID", F.when(first, own).otherwise(record_id(F.col("page_id"), F.concat(F.col("digest"), F.lit("/"), F.col("place").cast("string"))))),
        ("WARC-Date", date),
        ("WARC-Target-URI", target),
        ("Page-ID", F.when(first, F.col("page_id"))),
        ("WARC-Payload-Digest", F.when(first, F.concat(F.lit("sha256:"), "digest"))),
        ("WARC-Refers-To", F.when(revisit, record_id(F.col("refers_to"), F.col("digest")))),
        ("WARC-Profile", F.when(revisit, PROFILE)),
        ("WARC-Segment-Number", F.when(many, F.col("place") + 1)),
        ("WARC-Segment-Origin-ID", F.when(~first, own)),
        ("WARC-Segment-Total-Length", F.when(many & last, F.col("total"))),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", F.octet_length("piece")),
    )
    return cut.select(F.concat(head, F.col("piece").cast("string")).alias("value"))


def write(pages: DataFrame, path: str, **options) -> None:
    """Write an archive of the pages (page_id, url, html) into a folder."""
    records(pages, **options).write.text(path, compression="gzip", lineSep=CRLF + CRLF)


# --- reading -------------------------------------------------------------------------------------


class Records:
    """Cuts the bytes of one file, given piece by piece, into (headers, block, problem)."""

    def __init__(self):
        self.parts: list[bytes] = []
        self.size, self.need = 0, 1

    def feed(self, data: bytes) -> Iterator[tuple[dict[str, str], bytes, str | None]]:
        self.parts.append(data)
        self.size += len(data)
        if self.size < self.need:
            return
        text, at = b"".join(self.parts), 0
        while True:
            while text[at : at + 1] in (b"\r", b"\n"):
                at += 1
            if not text.startswith(b"WARC/", at):
                if len(text) - at < 5:
                    self.need = 6
                    break
                found = text.find(b"\nWARC/", at)
                stop = len(text) - 5 if found < 0 else found + 1
                if found < 0 and text[at:stop].strip(b"\0\r\n") or found >= 0:
                    yield {}, text[at:stop], "not a record"
                at = stop
                if found < 0:
                    self.need = 6
                    break
                continue
            end = text.find(b"\r\n\r\n", at)
            if end < 0:
                self.need = len(text) - at + 1
                break
            headers = {}
            for line in text[at:end].decode("utf-8", "replace").split(CRLF)[1:]:
                name, _, value = line.partition(":")
                headers[name.strip().lower()] = value.strip()
            length = headers.get("content-length", "")
            n = int(length) if length.isdecimal() else 0
            if end + 4 + n > len(text):
                self.need = end + 4 + n - at
                break
            yield headers, text[end + 4 : end + 4 + n], None if length.isdecimal() else "no length"
            at = end + 4 + n
        self.parts, self.size = [text[at:]], len(text) - at

    def rest(self) -> bytes:
        """What is left when the file has ended."""
        return b"".join(self.parts).strip(b"\0\r\n")


def unchunked(body: bytes) -> tuple[bytes, bool]:
    """The content of a chunked body, and whether its framing is whole."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        try:
            n = int(size, 16)
        except ValueError:
            return b"".join(out), False
        if n <= 0:
            return b"".join(out), n == 0
        if body[end + 2 + n : end + 4 + n] != b"\r\n":
            return b"".join([*out, body[end + 2 : end + 2 + n]]), False
        out.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n


def payload_of(block: bytes) -> tuple[bytes, str | None]:
    """The content of an HTTP message, without its transfer framing."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        return b"", "no HTTP head"
    for line in head.lower().split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        if name.strip() == b"transfer-encoding" and value.strip().endswith(b"chunked"):
            body, whole = unchunked(body)
            return body, None if whole else "broken chunks"
    return body, None


def _digested(block: bytes, declared: str | None) -> tuple[bytes, str, str | None]:
    payload, problem = payload_of(block)
    digest = hashlib.sha256(payload).hexdigest()
    name, _, value = (declared or "").partition(":")
    if not problem and name.lower() == "sha256" and value.lower() != digest:
        problem = "digest differs"
    return payload, digest, problem


def _number(text: str | None) -> int | None:
    return int(text) if text and text.lstrip("-").isdecimal() else None


_FIELDS = (
    ("file_path", pa.string()), ("kind", pa.string()), ("record_id", pa.string()), ("page_id", pa.int64()), ("target_uri", pa.string()), ("declared", pa.string()), ("refers", pa.string()),
    ("origin", pa.string()), ("segment", pa.int64()), ("total", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("problem", pa.string()),
)
_SCHEMA = (
    "file_path string, kind string, record_id string, page_id long, target_uri string, declared string, refers string, origin string, segment long, total long, "
    "payload_bytes long, payload_digest string, payload binary, problem string"
)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, _FIELDS, strict=True)], [name for name, _ in _FIELDS])


def scan(spark: SparkSession, path: str, keep: bool = False) -> DataFrame:
    """The records of an archive as they lie in its files; segments hold their bytes in ``payload``, whole records do if ``keep``."""

    def row(file: str, headers: dict[str, str], block: bytes, problem: str | None) -> tuple:
        kind, segment = headers.get("warc-type"), _number(headers.get("warc-segment-number"))
        record, declared = headers.get("warc-record-id"), headers.get("warc-payload-digest")
        origin = headers.get("warc-segment-origin-id") or (record if segment is not None else None)
        size = digest = payload = None
        if origin is not None:
            payload = block
        elif kind == "response":
            payload, digest, wrong = _digested(block, declared)
            size, problem = len(payload), problem or wrong
        return (
            file, kind, record, _number(headers.get("page-id")), headers.get("warc-target-uri"), declared, headers.get("warc-refers-to"), origin, segment,
            _number(headers.get("warc-segment-total-length")), size, digest, payload if keep or origin is not None else None, problem,
        )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, reader, rows, size = None, Records(), [], 0

        def ended() -> list[tuple]:
            return [row(file, {}, b"", "cut off")] if file is not None and reader.rest() else []

        for path, data in chunks(batches):
            if path != file:
                rows += ended()
                file, reader = path, Records()
            for found in reader.feed(data):
                rows.append(row(file, *found))
                size += len(found[1]) if rows[-1][12] is not None else 200
                if size >= HAND_ON:
                    yield _batch(rows)
                    rows, size = [], 0
        rows += ended()
        if rows:
            yield _batch(rows)

    return ordered_lines(spark, path).mapInArrow(run, _SCHEMA)


def assembled(pieces: DataFrame, keep: bool = False) -> DataFrame:
    """Records put together from their segments: (record_id, payload_bytes, payload_digest, payload, problem)."""
    single = pieces.groupBy("origin", "segment").agg(F.first("payload").alias("payload"), F.max("total").alias("total"), F.max("declared").alias("declared"))
    groups = single.groupBy("origin").agg(
        F.array_sort(F.collect_list(F.struct("segment", "payload"))).alias("parts"), F.max("total").alias("total"), F.max("declared").alias("declared")
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                origin, parts, total, declared = (column_of(batch, c)[i] for c in ("origin", "parts", "total", "declared"))
                numbers = parts.values.field("segment").to_pylist()
                block = b"".join(x or b"" for x in parts.values.field("payload").to_pylist())
                payload, digest, problem = _digested(block, declared.as_py())
                if numbers != list(range(1, len(numbers) + 1)):
                    problem = "missing segment"
                elif total.as_py() != len(block):
                    problem = "length differs"
                yield pa.RecordBatch.from_arrays(
                    [pa.array([origin.as_py()]), pa.array([len(payload)], pa.int64()), pa.array([digest]), pa.array([payload if keep else None], pa.binary()), pa.array([problem], pa.string())],
                    ["record_id", "payload_bytes", "payload_digest", "payload", "problem"],
                )

    return groups.mapInArrow(run, "record_id string, payload_bytes long, payload_digest string, payload binary, problem string")


def read(spark: SparkSession, path: str, keep: bool = False) -> DataFrame:
    """The pages of an archive: (page_id, target_uri, payload_bytes, payload_digest, record_type, refers_to, payload, problem).

    ``payload`` is null unless ``keep``, and always for revisits, whose content is that of the page they refer to. Segments whose first is missing have no page.
    """
    rows = written(scan(spark, path, keep), "warc-records")
    pieces = rows.filter("origin IS NOT NULL")
    names = ("page_id", "target_uri", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload", "problem")
    begun = pieces.filter("segment = 1").select("record_id", "page_id", "target_uri", F.lit(True).alias("__llm_begun"))
    put = begun.join(assembled(pieces, keep), "record_id", "full").withColumn("problem", F.when(F.col("__llm_begun").isNull(), "missing segment").otherwise(F.col("problem")))
    shared = ("record_id", "page_id", "target_uri", "payload_bytes", "payload_digest", "payload", "problem")
    responses = written(rows.filter("kind = 'response' AND origin IS NULL OR kind IS NULL").select(*shared).unionByName(put.select(*shared)), "warc-responses")
    revisits = rows.filter("kind = 'revisit'").select("page_id", "target_uri", "declared", "refers", F.col("problem").alias("__llm_problem"))
    times = revisits.groupBy("refers").agg(F.count(F.lit(1)).alias("times"))
    known = responses.groupBy(F.col("record_id").alias("refers")).agg(
        F.min("page_id").alias("refers_to"), F.first("payload_bytes").alias("payload_bytes"), F.first("payload_digest").alias("payload_digest"), F.max("problem").alias("__llm_broken")
    )
    held = written(known.join(times, "refers"), "warc-referred")
    found = join_counted(revisits, held, "refers", held.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0])
    wrong = (
        F.when(F.col("__llm_problem").isNotNull(), F.col("__llm_problem")).when(F.col("payload_digest").isNull(), "no such response")
        .when(F.col("__llm_broken").isNotNull(), F.col("__llm_broken")).when(F.col("declared") != F.concat(F.lit("sha256:"), "payload_digest"), "digest differs")
    )
    again = found.select("page_id", "target_uri", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), "refers_to", F.lit(None).cast("binary").alias("payload"), wrong.alias("problem"))
    first = responses.select("page_id", "target_uri", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), "payload", "problem")
    return first.select(*names).unionByName(again.select(*names))


def op11_warc_segments(spark, sf_dir: str) -> DataFrame:
    """All pages through an archive and back."""
    path = scratch_path(spark, "warc")
    write(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), path)
    return read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem")


ORACLE = {
    "op11_warc_segments": """
WITH sized AS (
  SELECT CAST(page_id AS BIGINT) AS page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), judged AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM sized
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first < coalesce(page_id, first + 1) THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first < coalesce(page_id, first + 1) THEN first END AS refers_to, CAST(NULL AS VARCHAR) AS problem
FROM judged
"""
}
