"""Media columns: content-defined chunks, deduplicated by digest, ordered chunk lists that rebuild verified payloads.

A payload is a text's UTF-8 bytes, padded with 255 to a positive multiple of ``FRAME`` 8-bit samples. A gear hash (each byte
shifts the hash left and adds a fixed random number) cuts it where its low bits are zero, between ``LEAST`` and ``MOST`` bytes apart, so equal
passages give equal chunks wherever they stand. Chunks are compressed one by one and known by a 128-bit digest.

Storage is two tables in the shared folder. *media* has a row per payload: its chunk list and the bytes of the chunks that no other
payload has. *chunks* holds every other chunk once. Which digests repeat is found from the digests alone; a filter of fixed size
tells the writing tasks, so payloads are written where they are read and only repeated chunks are shuffled. (A chunk that the
filter takes for a repeated one is stored in the chunk table as well.) Reading joins the chunk lists with the chunk table, checks every digest, and sets payloads together.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import blake2b, sha256
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitfold.llm.common import Membership, column_of, documents, partitions, seeded, sliced
from hitfold.session import scratch_path

FRAME, PAD = 576, 255
LEAST, MASK, MOST = 512, (1 << 10) - 1, 8192
MAGIC = b"CDC1"
_GEAR = (seeded(53, 256) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
_CODEC = "zstd"


def payload(text: bytes | None) -> bytes:
    text = text or b""
    return text + bytes([PAD]) * (-len(text) % FRAME if text else FRAME)


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash at every byte: sum of gear[b[i - k]] << k, doubled up from short runs; 32 bits hold the last 32 bytes."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8, 16):
        moved = h.copy()
        moved[k:] += h[:-k] << np.uint32(k)
        h = moved
    return h


def cut(data: bytes) -> list[int]:
    """Ends of the chunks of a payload."""
    hashes = gear(np.frombuffer(data, np.uint8))
    # the low bits depend on the last bytes alone; the high ones on all 32
    marks = np.flatnonzero((hashes >> np.uint32(16)) & np.uint32(MASK) == 0) + 1
    ends, at, n = [], 0, len(data)
    while n - at > LEAST:
        i = int(np.searchsorted(marks, at + LEAST))
        end = min(int(marks[i]) if i < len(marks) else n, at + MOST, n)
        ends.append(end)
        at = end
    if at < n:
        ends.append(n)
    return ends


def chunks(data: bytes) -> list[tuple[bytes, bytes]]:
    """(digest, bytes) of the chunks of a payload, in order."""
    ends = cut(data)
    return [(blake2b(data[a:b], digest_size=16).digest(), data[a:b]) for a, b in zip([0, *ends], ends, strict=False)]


def halves(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)


class Stored(NamedTuple):
    """Where a written collection lies: the two tables."""

    media: str
    chunks: str


# --- writing -------------------------------------------------------------------------------------


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return column_of(batch, "text").cast(pa.binary()).to_pylist()


def write(docs: DataFrame, folder: str) -> Stored:
    """Store the payload of every text (doc_id, text; null is empty). Rows that repeat a doc_id are stored each."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def list_digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            pairs = halves([d for text in _texts(batch) for d, _ in chunks(payload(text))])
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["d1", "d2"])

    repeated = docs.mapInArrow(list_digests, "d1 long, d2 long").groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = Membership(repeated.select("d1"), "d1")

    def lay_out(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 40
        for batch in sliced(batches):
            rows = []
            for doc_id, text in zip(column_of(batch, "doc_id").to_pylist(), _texts(batch), strict=True):
                data = payload(text)
                parts = chunks(data)
                away = shared.holds(halves([d for d, _ in parts])[:, 0].view(np.uint64))
                held = [pa.compress(b, _CODEC, asbytes=True) for (_, b), far in zip(parts, away.tolist(), strict=True) if not far]
                rows.append((key, doc_id, len(text or b""), b"".join(d for d, _ in parts), [len(b) for _, b in parts], away.tolist(), held))
                key += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _MEDIA, strict=True)], schema=_MEDIA)

    def repeat(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = {d: b for text in _texts(batch) for d, b in chunks(payload(text))}
            pairs = halves(list(found))
            away = np.flatnonzero(shared.holds(pairs[:, 0].view(np.uint64)))
            held = list(found.values())
            yield pa.RecordBatch.from_arrays(
                [pa.array(pairs[away, 0]), pa.array(pairs[away, 1]), pa.array([pa.compress(held[i], _CODEC, asbytes=True) for i in away.tolist()], pa.binary())], ["d1", "d2", "bytes"]
            )

    stored = Stored(f"{folder}/media", f"{folder}/chunks")
    docs.mapInArrow(lay_out, MEDIA).write.option("compression", "none").parquet(stored.media)
    once = docs.mapInArrow(repeat, "d1 long, d2 long, bytes binary").groupBy("d1", "d2").agg(F.first("bytes").alias("bytes"))
    once.write.option("compression", "none").parquet(stored.chunks)
    return stored


MEDIA = "key long, doc_id long, n_bytes long, digests binary, lengths array<int>, away array<boolean>, held array<binary>"
_MEDIA = pa.schema(
    [("key", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("digests", pa.binary()), ("lengths", pa.list_(pa.int32())),
     ("away", pa.list_(pa.bool_())), ("held", pa.list_(pa.binary()))]
)


# --- reading -------------------------------------------------------------------------------------


def rebuild(row: dict, fetched: dict[int, bytes]) -> tuple[bytes, bytes]:
    """(payload, stored form) of a media row and its chunks from the chunk table, by place; raises where a digest differs.

    The stored form is the chunk list, digests and lengths in order, followed by the compressed chunks in order.
    """
    held, stored, parts = iter(row["held"]), [], []
    for i, (away, size) in enumerate(zip(row["away"], row["lengths"], strict=True)):
        packed = fetched[i] if away else next(held)
        part = pa.decompress(packed, size, _CODEC, asbytes=True)
        if blake2b(part, digest_size=16).digest() != row["digests"][16 * i : 16 * i + 16]:
            raise ValueError(f"chunk {i} of payload {row['key']} differs from its digest")
        stored.append(packed)
        parts.append(part)
    head = MAGIC + np.array([row["n_bytes"], len(parts)], "<i8").tobytes() + row["digests"] + np.array(row["lengths"], "<i4").tobytes()
    return b"".join(parts), head + b"".join(stored)


def feature(data: bytes) -> str:
    """Of the samples read back: which 64 of 65 stretches are darker than the next, their spread, and the share of rising samples."""
    samples = np.frombuffer(data, np.uint8)
    means = np.add.reduceat(samples, np.arange(65) * len(samples) // 65, dtype=np.int64) / np.diff(np.append(np.arange(65) * len(samples) // 65, len(samples)))
    bits = int.from_bytes(np.packbits(means[:-1] < means[1:]).tobytes(), "big")
    counts = np.bincount(samples, minlength=256) / len(samples)
    spread = -(counts[counts > 0] * np.log2(counts[counts > 0])).sum()
    return f"{bits:016x}-{spread:.4f}-{(samples[1:] > samples[:-1]).mean():.4f}"


def read(spark: SparkSession, stored: Stored) -> DataFrame:
    """(doc_id, n_bytes, payload, media) of every stored row."""
    media = spark.read.schema(MEDIA).parquet(stored.media)
    return _read(spark, stored, media, False)


def _outcome(row: dict, fetched: dict[int, bytes], summed: bool) -> tuple:
    data, form = rebuild(row, fetched)
    if not summed:
        return row["doc_id"], row["n_bytes"], data, form
    return row["doc_id"], row["n_bytes"], len(data), sha256(data).hexdigest(), crc32(data[-32:]), len(form), sha256(form).hexdigest(), feature(data)


_READ = "doc_id long, n_bytes long, payload binary, media binary"
_SUMMED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
_TYPES = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _read(spark: SparkSession, stored: Stored, media: DataFrame, summed: bool) -> DataFrame:
    schema = _SUMMED if summed else _READ
    fields = [f.split() for f in schema.split(", ")]
    arrow = pa.schema([(n, _TYPES[t]) for n, t in fields])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    def alone(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 64):
                yield batch([_outcome(row, {}, summed) for row in b.slice(i, 64).to_pylist()])

    def joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, fetched, key = None, {}, None
        for b in batches:
            out = []
            for x in b.to_pylist():
                if x["key"] != key:
                    if row is not None:
                        out.append(_outcome(row, fetched, summed))
                    row, fetched, key = None, {}, x["key"]
                if x["place"] < 0:
                    row = x
                else:
                    fetched[x["place"]] = x["bytes"]
            if out:
                yield batch(out)
        if row is not None:
            yield batch([_outcome(row, fetched, summed)])

    far = F.array_contains("away", True)
    names = [f.split()[0] for f in MEDIA.split(", ")]
    kept = media.filter(far).select(*names, F.lit(-1).alias("place"), F.lit(None).cast("binary").alias("bytes"))
    links = (
        media.filter(far).select("key", "digests", "away").mapInArrow(_references, "key long, place int, d1 long, d2 long")
        .join(spark.read.schema("d1 long, d2 long, bytes binary").parquet(stored.chunks), ["d1", "d2"])
    )
    fetched = links.select("key", *[F.lit(None).cast(f.dataType).alias(f.name) for f in media.schema if f.name != "key"], "place", "bytes")
    whole = kept.unionByName(fetched).repartition(partitions(spark), "key").sortWithinPartitions("key", "place").mapInArrow(joined, schema)
    return media.filter(~far).mapInArrow(alone, schema).unionByName(whole)


def _references(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [
            (key, i, *map(int, np.frombuffer(digests, "<i8", 2, 16 * i)))
            for key, digests, away in zip(*(column_of(b, c).to_pylist() for c in ("key", "digests", "away")), strict=True)
            for i, far in enumerate(away) if far
        ]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["key", "place", "d1", "d2"])


def summary(spark: SparkSession, stored: Stored) -> DataFrame:
    """Sizes, digests and a feature of every payload, computed from the bytes read back."""
    return _read(spark, stored, spark.read.schema(MEDIA).parquet(stored.media), True)


def op7_media_chunks(spark, sf_dir: str) -> DataFrame:
    """All documents stored as deduplicated chunks and read back."""
    return summary(spark, write(documents(spark, sf_dir, "doc_id", "text"), scratch_path(spark, "media")))
