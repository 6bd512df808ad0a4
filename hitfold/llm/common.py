"""Shared helpers: scratch tables, byte-level words of Arrow batches, bounded membership filters, components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hitfold.session import stored

#: ``[\x20\x09-\x0D]``, the separators of words.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Bytes of text handled at once inside a task; bounds the numpy temporaries.
SLICE_BYTES = 1 << 20


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The ``documents`` table, narrowed to ``columns`` when some are named."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read back, so that nothing before it runs again."""
    return stored(df, label)[0]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucket_of(doc_id: Column, salt: int, modulus: int) -> Column:
    """The training fold of a document: crc32 of its decimal id modulo ``modulus`` equals ``salt``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus == salt


# --- Arrow batches -------------------------------------------------------------------------------


def sliced(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds at most ``limit`` bytes of ``column``, or a single row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.zeros(batch.num_rows, np.int64)
        _, offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))
        sizes[:] = np.diff(offsets)
        start, total = 0, 0
        for i, size in enumerate(sizes.tolist()):
            if i > start and total + size > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        yield batch.slice(start)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column, end to end, and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(buffers[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if buffers[2] is None or offsets[-1] == offsets[0]:
        return np.empty(0, np.uint8), offsets - offsets[0]
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def column_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


# --- hashing -------------------------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def seeded(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit values."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


_BYTE = seeded(11, 256)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_UNBASE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n + 1:
        size = max(n + 1, SLICE_BYTES + 1)
        for name, base in (("up", _BASE), ("down", _UNBASE)):
            run = np.full(size, base, np.uint64)
            run[0] = 1
            _powers[name] = np.cumprod(run)
    return _powers["up"], _powers["down"]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, from one running sum over ``data``."""
    up, down = _power(len(data))
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each lower-cased word (``[^\\x20\\x09-\\x0D]+`` after A-Z to a-z).

    Long inputs are hashed in pieces cut between words, so memory stays a small multiple of the text.
    """
    if not len(data):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    data = _LOWER[data]
    blank = _SPACE[data]
    first = np.empty(len(data) + 1, bool)
    first[0] = True
    first[1:-1] = blank[:-1]
    first[-1] = False
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    first[inner] = True
    starts = np.flatnonzero(first[:-1] & ~blank)
    if not len(starts):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    last = np.empty(len(data), bool)
    last[:-1] = blank[1:]
    last[-1] = True
    last[inner - 1] = True
    ends = np.flatnonzero(last & ~blank) + 1
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SLICE_BYTES, "right")))
        at = starts[i]
        out[i:j] = span_hashes(data[at : ends[j - 1]], starts[i:j] - at, ends[i:j] - at)
        i = j
    return out, np.searchsorted(offsets, starts, "right") - 1


# --- packed integers -----------------------------------------------------------------------------


def squeeze(values: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, compressed: planes of small or sorted values take almost no room."""
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize)
    return len(values).to_bytes(8, "little") + (pa.compress(np.ascontiguousarray(raw.T).tobytes(), "zstd", asbytes=True) if len(values) else b"")


def expand(blob: bytes, kind: str) -> np.ndarray:
    n, size = int.from_bytes(blob[:8], "little"), np.dtype(kind).itemsize
    if not n:
        return np.empty(0, kind)
    raw = pa.decompress(blob[8:], n * size, "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).reshape(-1).view(kind)


def squeeze_sorted(values: np.ndarray) -> bytes:
    """Ascending 64-bit integers by their differences."""
    return squeeze(np.diff(values, prepend=np.uint64(0)))


def expand_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(expand(blob, "<u8"), dtype=np.uint64)


# --- membership with a bounded broadcast ---------------------------------------------------------

#: Bits of a membership filter: 2 MiB, whatever the data. More keys only raise the share of false hits.
FILTER_BITS = 1 << 24
_SHIFTS = (0, 20, 40)


class Membership:
    """A Bloom filter of fixed size over a column of 64-bit hashes, small enough to broadcast at any scale.

    A miss is certain; a false hit only sends a row the exact, shuffled way. Results never depend on it.
    """

    def __init__(self, keys: DataFrame, column: str, bits: int = FILTER_BITS):
        slots = F.array(*[F.shiftrightunsigned(F.col(column), s).bitwiseAND(F.lit(bits - 1)) for s in _SHIFTS])
        rows = (
            keys.select(F.explode(slots).alias("p"))
            .groupBy(F.shiftright("p", 6).alias("w"))
            .agg(F.bit_or(F.expr("shiftleft(1L, CAST(p & 63 AS INT))")).alias("b"))
            .toArrow()  # at most bits / 64 rows
        )
        field = np.zeros(bits // 64, np.int64)
        field[rows.column("w").to_numpy()] = rows.column("b").to_numpy()
        self.bits = bits
        self.field = keys.sparkSession.sparkContext.broadcast(field)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        """Inside a task: which hashes may be members."""
        hashes, found = hashes.astype(np.uint64, copy=False), np.ones(len(hashes), bool)
        field = self.field.value
        for s in _SHIFTS:
            at = ((hashes >> np.uint64(s)) & np.uint64(self.bits - 1)).astype(np.int64)
            found &= (field[at >> 6] >> (at & 63)) & 1 != 0
        return found


# --- components ----------------------------------------------------------------------------------


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """Nodes of ``links`` with the smallest node they reach: (node, component).

    Distributed union-find: each round joins every node's neighbours to the least of them (large star, then
    small star), which halves chains as path compression does. Both sides of a star are folded
    in their tasks before the shuffle, so a node with many links costs one row a task in the fold.
    Every round is written to the shared folder; only counts reach the driver.
    """
    a, b = F.col(left).cast("long"), F.col(right).cast("long")
    edges = written(links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a <> b").distinct(), "links")
    seen = None
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        # large star: neighbours above a node move to its least neighbour
        large = both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").filter("a <> b").distinct()
        # small star: a node and its neighbours below it move to the least of them
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(F.col("m").alias("x"), F.explode(F.array("a", "b")).alias("y")).filter("x <> y")
        edges = written(small.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "links")
        state = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    return edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component")).union(
        edges.select("a", F.col("a").alias("component")).distinct()
    )
