"""Token-id output: Simple-8b words with block offsets, written and read back by Spark.

A *segment* is the file image of some whole documents in order: a header, the doc_ids and token counts, the word offset of every
block of 1,024 ids, escaped values, and 64-bit words. The top four bits of a word select how many ids of which width
its other 60 bits hold; selector 0 points to an escaped value wider than 60 bits. Blocks start at a word of their own, so any
block can be decoded alone and all blocks are packed and unpacked together, as columns of numpy arrays.

Segments are rows of Parquet files, so that any file system Spark writes to can hold them: (part, segment, image),
where (part, segment) ascends with doc_id.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hitfold.llm.common import column_of, documents, partitions, sliced, written
from hitfold.llm.tokens import encoder
from hitfold.session import scratch_path

MAGIC = b"S8BTOK1\n"
BLOCK, SEGMENT_IDS = 1024, 1 << 21
#: Ids a word and bits an id, by selector from 1 on.
SELECTORS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
_WIDTH = np.maximum(np.frexp(np.arange(1 << 16))[1], 1).astype(np.uint8)
_COUNT = np.array([1, *(c for c, _ in SELECTORS)], np.int64)


def widths(values: np.ndarray) -> np.ndarray:
    """Bits of each value, at least 1."""
    if not values.size or values.max() < 1 << 16:
        return _WIDTH[values.astype(np.uint16)]
    bits = np.ones(values.shape, np.uint8)
    for k in range(1, 64):
        if not (wide := values >> np.uint64(k)).any():
            break
        bits += wide > 0
    return bits


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, word offset of each block, escaped values) of a run of unsigned integers."""
    n = len(values)
    blocks = -(-n // BLOCK)
    if not blocks:
        return np.empty(0, np.uint64), np.zeros(0, np.uint32), np.empty(0, np.uint64)
    room = BLOCK + 60  # a block's last word may reach beyond it; zeros there take no width
    grid = np.zeros((blocks, room), np.uint64)
    padded = np.zeros(blocks * BLOCK, np.uint64)
    padded[:n] = values
    grid[:, :BLOCK] = padded.reshape(blocks, BLOCK)
    bits = widths(grid)
    bits[:, BLOCK:] = 0
    # widest of the next c values, from two overlapping runs that are known already
    widest = {1: bits}
    for count, _ in reversed(SELECTORS[:-1]):
        half = max(c for c in widest if c <= count and 2 * c >= count)
        known, shift = widest[half], count - half
        moved = np.zeros_like(known)
        moved[:, : room - shift] = known[:, shift:]
        widest[count] = np.maximum(known, moved)
    chosen = np.zeros((blocks, room), np.uint8)
    for selector in range(len(SELECTORS), 0, -1):
        count, width = SELECTORS[selector - 1]
        chosen[widest[count] <= width] = selector
    # all blocks walk from word to word together
    lengths = np.full(blocks, BLOCK, np.int64)
    lengths[-1] = n - (blocks - 1) * BLOCK
    at, live, starts = np.zeros(blocks, np.int64), np.arange(blocks), []
    while len(live):
        starts.append(live * room + at[live])
        at[live] += _COUNT[chosen[live, at[live]]]
        live = live[at[live] < lengths[live]]
    places = np.sort(np.concatenate(starts))
    picked, flat = chosen.reshape(-1)[places], grid.reshape(-1)
    words = picked.astype(np.uint64) << np.uint64(60)
    for selector, (count, width) in enumerate(SELECTORS, 1):
        rows = np.flatnonzero(picked == selector)
        for k in range(count if len(rows) else 0):
            words[rows] |= flat[places[rows] + k] << np.uint64(k * width)
    wide = np.flatnonzero(picked == 0)
    words[wide] = np.arange(len(wide), dtype=np.uint64)
    offsets = np.searchsorted(places, np.arange(blocks) * room).astype(np.uint32)
    return words, offsets, flat[places[wide]]


def unpack(words: np.ndarray, offsets: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` integers of packed blocks."""
    picked = (words >> np.uint64(60)).astype(np.int64)
    counts = _COUNT[picked]
    ends = np.append(offsets[1:], len(words)).astype(np.int64)
    upto = np.concatenate([[0], np.cumsum(counts)])
    held = np.full(len(offsets), BLOCK, np.int64)
    if len(held):
        held[-1] = n - (len(held) - 1) * BLOCK
        counts[ends - 1] -= upto[ends] - upto[offsets.astype(np.int64)] - held
    at = np.cumsum(counts) - counts
    out = np.zeros(n, np.uint64)
    for selector, (count, width) in enumerate(SELECTORS, 1):
        rows = np.flatnonzero(picked == selector)
        mask = np.uint64((1 << width) - 1)
        for k in range(count if len(rows) else 0):
            use = rows[counts[rows] > k]
            out[at[use] + k] = (words[use] >> np.uint64(k * width)) & mask
    wide = np.flatnonzero(picked == 0)
    out[at[wide]] = escapes[words[wide].astype(np.int64)]
    return out


def image(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """A segment of whole documents."""
    words, offsets, escapes = pack(ids)
    head = np.array([len(doc_ids), len(ids), len(offsets), len(escapes), len(words)], "<i8")
    parts = (doc_ids.astype("<i8"), lengths.astype("<i8"), offsets.astype("<u4"), escapes.astype("<u8"), words.astype("<u8"))
    return MAGIC + head.tobytes() + b"".join(x.tobytes() for x in parts)


def documents_of(blob: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """(doc_id, ids) of a segment, ids as unsigned 32-bit integers."""
    if blob[:8] != MAGIC:
        raise ValueError("not a segment of token ids")
    docs, n, blocks, escaped, count = np.frombuffer(blob, "<i8", 5, 8).tolist()
    at, read = 48, []
    for kind, size in (("<i8", docs), ("<i8", docs), ("<u4", blocks), ("<u8", escaped), ("<u8", count)):
        read.append(np.frombuffer(blob, kind, size, at))
        at += read[-1].nbytes
    doc_ids, lengths, offsets, escapes, words = read
    ids = unpack(words, offsets, escapes, n).astype("<u4")
    ends = np.cumsum(lengths)
    for doc_id, a, b in zip(doc_ids.tolist(), (ends - lengths).tolist(), ends.tolist(), strict=True):
        yield doc_id, ids[a:b]


# --- writing and reading -------------------------------------------------------------------------


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0) -> None:
    """Write the ids of every text, each document ended by ``end_id``, in ascending doc_id order.

    A null text is empty. Rows that repeat a doc_id follow each other in text order; a row without doc_id comes first. Other
    columns aren't read. An empty table writes an empty folder of files.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokens, part, segment = encoder(tokenizer), TaskContext.get().partitionId(), 0
        end = np.array([end_id], tokens.kind).tobytes()
        keys, sizes, held, total = [], [], [], 0

        def row() -> pa.RecordBatch:
            lengths = np.array(sizes, np.int64) // tokens.kind.itemsize
            ids = np.frombuffer(b"".join(held), tokens.kind).astype(np.uint64)
            blob = image(np.array(keys, np.int64), lengths, ids)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([segment], pa.int64()), pa.array([blob], pa.binary())], ["part", "segment", "image"])

        for batch in sliced(batches):
            for doc_id, text in zip(column_of(batch, "doc_id").to_pylist(), column_of(batch, "text").to_pylist(), strict=True):
                blob = tokens.encode(text) + end
                keys.append(NO_ID if doc_id is None else doc_id)
                sizes.append(len(blob))
                held.append(blob)
                total += len(blob)
                if total >= SEGMENT_IDS * tokens.kind.itemsize:
                    yield row()
                    segment += 1
                    keys, sizes, held, total = [], [], [], 0
        if keys:
            yield row()

    (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .repartitionByRange(partitions(docs.sparkSession), "doc_id")
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(encode, "part int, segment long, image binary")
        .write.option("compression", "none").parquet(path)
    )


#: Stands for a missing doc_id in the files.
NO_ID = -(1 << 63)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The documents of written files: (part, segment, place, doc_id, ids), ids as little-endian 32-bit integers."""

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, segment, blob in zip(*(column_of(batch, c).to_pylist() for c in ("part", "segment", "image")), strict=True):
                found = list(documents_of(blob))
                n = len(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * n, pa.int32()), pa.array([segment] * n, pa.int64()), pa.array(range(n), pa.int64()),
                     pa.array([None if d == NO_ID else d for d, _ in found], pa.int64()), pa.array([x.tobytes() for _, x in found], pa.binary())],
                    ["part", "segment", "place", "doc_id", "ids"],
                )

    return spark.read.schema("part int, segment long, image binary").parquet(path).mapInArrow(decode, "part int, segment long, place long, doc_id long, ids binary")


def summary(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of written files: start counts the ids of all documents before."""

    def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, segment, blob in zip(*(column_of(batch, c).to_pylist() for c in ("part", "segment", "image")), strict=True):
                found = [(d, len(x), crc32(x.tobytes())) for d, x in documents_of(blob)]
                keys, sizes, sums = zip(*found, strict=True)
                starts = np.cumsum(sizes) - np.array(sizes)
                n = len(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * n, pa.int32()), pa.array([segment] * n, pa.int64()), pa.array([None if d == NO_ID else d for d in keys], pa.int64()),
                     pa.array(starts), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64())],
                    ["part", "segment", "doc_id", "inner", "n_tokens", "ids_crc32"],
                )

    rows = written(
        spark.read.schema("part int, segment long, image binary").parquet(path)
        .mapInArrow(check, "part int, segment long, doc_id long, inner long, n_tokens long, ids_crc32 long"),
        "ids",
    )
    sums = rows.groupBy("part", "segment").agg(F.sum("n_tokens").alias("n"))
    within = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    parts = sums.groupBy("part").agg(F.sum("n").alias("n")).select("part", F.coalesce(F.sum("n").over(across), F.lit(0)).alias("base"))
    offsets = (
        sums.withColumn("skip", F.coalesce(F.sum("n").over(within), F.lit(0))).join(parts, "part")
        .select("part", "segment", (F.col("base") + F.col("skip")).alias("begin"))
    )
    return rows.join(offsets, ["part", "segment"]).select("doc_id", (F.col("begin") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def op4_token_ids(spark, sf_dir: str) -> DataFrame:
    """All documents written as token ids and summed up from the files."""
    import public_tokenizers

    path = scratch_path(spark, "token-ids")
    write(documents(spark, sf_dir, "doc_id", "text"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return summary(spark, path)
