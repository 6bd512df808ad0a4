"""Document fingerprints: digests of improbable features in chained Bloom filters, compared by normalised bit overlap.

1. Windows of ``WINDOW`` bytes start at every byte; a shorter text is one window.
   A window's rarity is how seldom its entropy (of its bytes' low five bits) is among all windows of all documents: one
   pass over the corpus makes this table of ``LEVELS`` numbers.
2. Among each ``SPREAD`` windows in a row the rarest gets a point, the first by a hash of its bytes among equals; windows that get ``POINTS``, equal ones
   together, are the features. Texts of fewer than ``FEW`` windows have all of them.
3. A feature sets ``BITS_SET`` bits of a filter of ``FILTER_BYTES``; after ``ROOM`` features the next filter of the chain begins.
4. The likeness of two chains is the mean, over the shorter one's filters, of the best overlap with a filter of the other: shared
   bits beyond those expected by chance, against the most there could be.
"""

from __future__ import annotations

from base64 import b64decode, b64encode
from collections.abc import Iterable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitfold.llm.common import column_of, documents, mix, partitions, sliced, span_hashes, text_bytes

WINDOW, LEVELS = 16, 256
SPREAD, POINTS, FEW = 64, 24, 256  # SPREAD is a power of two
FILTER_BYTES, BITS_SET, ROOM = 256, 5, 96
_BITS = FILTER_BYTES * 8
#: c log2 c in fixed point, so that sums are exact, and what the next equal byte adds to it.
_FIXED = 1 << 20
_LOG = np.round(np.concatenate([[0.0], np.arange(1, WINDOW + 1) * np.log2(np.arange(1, WINDOW + 1))]) * _FIXED).astype(np.int64)
_STEP = np.diff(_LOG)
NO_ID = -(1 << 63)


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the windows of end-to-end texts; a text shorter than a window is its own only one."""
    sizes = np.diff(offsets)
    many = np.where(sizes > 0, np.maximum(sizes - WINDOW + 1, 1), 0)
    row = np.repeat(np.arange(len(sizes)), many)
    starts = np.arange(len(row)) + np.repeat(offsets[:-1] - np.cumsum(many) + many, many)
    return starts, np.minimum(starts + WINDOW, offsets[row + 1]), row


def levels(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Entropy of each window, as one of ``LEVELS`` steps."""
    symbol = data & np.uint8(31)
    out = np.zeros(len(starts), np.int64)
    n = len(data) - WINDOW + 1
    if n > 0:  # a window's sum is the one before it, with one byte in and one out
        before, behind = np.zeros(len(data), np.uint8), np.zeros(len(data), np.uint8)
        for k in range(1, WINDOW):
            same = (symbol[k:] == symbol[:-k]).view(np.uint8)
            before[k:] += same
            behind[:-k] += same
        change = _STEP[before[WINDOW:]] - _STEP[behind[: n - 1]]
        first = int(_LOG[np.bincount(symbol[:WINDOW])].sum())
        sums = np.concatenate([[first], first + np.cumsum(change)])
    sizes = ends - starts
    full = sizes == WINDOW
    if n > 0:
        out[full] = sums[starts[full]]
    for i in np.flatnonzero(~full).tolist():
        out[i] = _LOG[np.bincount(symbol[starts[i] : ends[i]])].sum()
    sizes = np.maximum(sizes, 1)
    return np.clip((np.log2(sizes) - out / (sizes * _FIXED)) / 5 * (LEVELS - 1), 0, LEVELS - 1).astype(np.int64)


def rarity(docs: DataFrame) -> np.ndarray:
    """How often each entropy level is among the windows of all texts: at most ``LEVELS`` rows reach the driver."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LEVELS, np.int64)
        for batch in sliced(batches):
            data, offsets = text_bytes(column_of(batch, "text"))
            starts, ends, _ = windows(data, offsets)
            total += np.bincount(levels(data, starts, ends), minlength=LEVELS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(LEVELS)), pa.array(total)], ["level", "n"])

    rows = docs.select("text").mapInArrow(count, "level long, n long").groupBy("level").agg(F.sum("n").alias("n")).collect()
    table = np.zeros(LEVELS, np.int64)
    for r in rows:
        table[r["level"]] = r["n"]
    return table


def digests(texts: list[bytes], table: np.ndarray) -> list[np.ndarray]:
    """The filter chain of each text: (filters, bytes); no filters for an empty text."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    starts, ends, row = windows(data, offsets)
    if not len(starts):
        return [np.empty((0, FILTER_BYTES), np.uint8)] * len(texts)
    hashes = span_hashes(data, starts, ends)
    rank = np.argsort(np.argsort(table, kind="stable"))[levels(data, starts, ends)].astype(np.uint64)
    order = rank << np.uint64(52) | hashes >> np.uint64(12)
    # the rarest of each run of windows; runs don't leave their text, short texts have one run
    edges = np.searchsorted(row, np.arange(len(texts) + 1))
    sizes = np.diff(edges)
    points = np.zeros(len(starts), np.int64)
    if len(starts) >= SPREAD:
        best, at, step = order.copy(), np.arange(len(order)), 1
        while step < SPREAD:  # the least of twice as many in a row each time, the first among equals
            less = best[step:] < best[:-step]
            at = np.where(less, at[step:], at[:-step])
            best = np.minimum(best[:-step], best[step:])
            step *= 2
        whole = row[: len(best)] == row[SPREAD - 1 :]
        points += np.bincount(at[whole], minlength=len(points))
    # equal windows of a text share their points, so that one that repeats is a feature
    some = np.flatnonzero(points)
    by_hash = some[np.lexsort((hashes[some], row[some]))]
    first = np.flatnonzero(np.concatenate([[True], (np.diff(row[by_hash]) != 0) | (np.diff(hashes[by_hash]) != 0)])) if len(some) else some
    if len(some):
        points[by_hash] = np.repeat(np.add.reduceat(points[by_hash], first), np.diff(np.append(first, len(by_hash))))
    chosen = points >= POINTS
    chosen |= (sizes < FEW)[row]
    none = np.bincount(row[chosen], minlength=len(texts)) == 0
    chosen |= none[row] & (points > 0)
    places = np.flatnonzero(chosen)
    out = []
    cuts = np.searchsorted(places, edges)
    for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
        own = hashes[places[a:b]]
        _, first = np.unique(own, return_index=True)
        own = mix(own[np.sort(first)])
        bits = np.zeros((-(-len(own) // ROOM), _BITS), np.uint8)
        link = np.arange(len(own)) // ROOM
        for k in range(BITS_SET):
            bits[link, (own >> np.uint64(11 * k)).astype(np.int64) % _BITS] = 1
        out.append(np.packbits(bits, axis=1))
    return out


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    """0 to 1; 1 for equal chains, also for two empty ones; 0 if only one is empty."""
    if x.shape == y.shape and (x == y).all():
        return 1.0
    if not len(x) or not len(y):
        return 0.0
    if len(x) > len(y):
        x, y = y, x
    a, b = (np.unpackbits(v, axis=1).astype(np.float32) for v in (x, y))
    na, nb = a.sum(axis=1), b.sum(axis=1)
    best = np.zeros(len(a))
    for i in range(0, len(b), 512):
        chance = na[:, None] * nb[None, i : i + 512] / _BITS
        most = np.minimum(na[:, None], nb[None, i : i + 512])
        best = np.maximum(best, ((a @ b[i : i + 512].T - chance) / np.maximum(most - chance, 1)).max(axis=1))
    return float(np.clip((best * na).sum() / na.sum(), 0, 1))


def to_text(chain: np.ndarray) -> str:
    return b64encode(chain.tobytes()).decode()


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(b64decode(text), np.uint8).reshape(-1, FILTER_BYTES)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``docs`` with ``fingerprint``, the chain of its text in base 64; null and empty texts have an empty one.

    Other columns pass through; a column named fingerprint is replaced. Two passes over the texts, no shuffle of them.
    """
    table = docs.sparkSession.sparkContext.broadcast(rarity(docs))
    docs = docs.drop("fingerprint")
    names = docs.columns

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = [t or b"" for t in column_of(batch, "text").cast(pa.binary()).to_pylist()]
            marks = [to_text(x) for x in digests(texts, table.value)]
            yield pa.RecordBatch.from_arrays([*(column_of(batch, n) for n in names), pa.array(marks, pa.string())], [*names, "fingerprint"])

    return docs.mapInArrow(add, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "fingerprint string"]))


# --- each document against its successor ---------------------------------------------------------


def with_next(docs: DataFrame) -> tuple[DataFrame, int]:
    """Rows in ranges of doc_id, each range with a copy of the document that follows its last one; and the number of ranges.

    Sorted by (range, copy, id descending, text), a row's successor is the row after it in its range, or else the first copy. The
    following documents are found from the ids alone: one row a range reaches the driver.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    cuts = keyed.select(F.col("id").cast("double").alias("x")).approxQuantile("x", [i / n for i in range(1, n)], 0.2 / n)
    splits = sorted({-float("inf"), *cuts, float("inf")})
    ranged = keyed.withColumn("range", F.lit(0))
    if len(splits) > 2:
        placed = Bucketizer(splits=splits, inputCol="x", outputCol="place").transform(keyed.withColumn("x", F.col("id").cast("double")))
        ranged = placed.select("id", "text", F.col("place").cast("int").alias("range"))
    last = {r["range"]: r["top"] for r in ranged.groupBy("range").agg(F.max("id").alias("top")).collect()}
    filled = sorted(last)
    follows = [(last[below], above) for below, above in zip([filled[-1], *filled[:-1]], filled, strict=True)] if filled else []
    edges = F.broadcast(spark.createDataFrame(follows, "id long, to int").groupBy("id").agg(F.collect_list("to").alias("to")))  # a row a range
    copied = ranged.join(edges, "id").select("id", "text", F.explode("to").alias("range"), F.lit(True).alias("copy"))
    return ranged.withColumn("copy", F.lit(False)).select("id", "text", "range", "copy").union(copied), n


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness:
    (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    The edit replaces the last third of the code points by as many from the start of the next document in descending doc_id order (the
    first follows the last). A null text is empty, a row without doc_id comes last, rows that repeat a doc_id are in text order, a single row follows itself.
    Other columns aren't read; an empty table gives no rows.
    """
    table = docs.sparkSession.sparkContext.broadcast(rarity(docs))
    rows, n = with_next(docs)

    def out(pairs: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
        edited, sizes = [], []
        for _, text, after in pairs:
            own = text.decode()
            third = len(own) // 3
            sizes.append(len(own))
            edited.append((own[: len(own) - third] + after.decode()[:third]).encode())
        # texts and successors overlap but for the last
        chain = digests([t for _, t, _ in pairs] + edited + [pairs[-1][2]], table.value)
        own, changed = chain[: len(pairs)], chain[len(pairs) : -1]
        return pa.RecordBatch.from_arrays(
            [pa.array([None if i == NO_ID else i for i, _, _ in pairs], pa.int64()), pa.array(sizes, pa.int64()), pa.array([sha256(e).hexdigest() for e in edited]),
             pa.array(map(to_text, own), pa.string()), pa.array(map(to_text, changed), pa.string()),
             pa.array([likeness(x, y) for x, y in zip(own, changed, strict=True)], pa.float64()),
             pa.array([likeness(x, y) for x, y in zip(own, [*own[1:], chain[-1]], strict=True)], pa.float64())],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, waiting, pairs, size, after = None, None, [], 0, None
        for batch in sliced(batches):
            for key, text, part, copy in zip(
                column_of(batch, "id").to_pylist(), column_of(batch, "text").cast(pa.binary()).to_pylist(), column_of(batch, "range").to_pylist(),
                column_of(batch, "copy").to_pylist(), strict=True,
            ):
                if part != here:
                    if waiting:
                        yield out([*pairs, (*waiting, after)])
                    here, waiting, pairs, size, after = part, None, [], 0, None
                if copy:
                    after = text if after is None else after
                    continue
                if waiting:
                    pairs.append((*waiting, text))
                    size += len(waiting[1])
                    if size > 1 << 19:
                        yield out(pairs)
                        pairs, size = [], 0
                waiting = (key, text)
        if waiting:
            yield out([*pairs, (*waiting, after)])

    return (
        rows.repartitionById(n, F.col("range")).sortWithinPartitions("range", F.col("copy").desc(), F.col("id").desc(), "text")
        .mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    )


def op5_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    """All documents against their edited texts and their successors."""
    return edited_likeness(documents(spark, sf_dir, "doc_id", "text"))
