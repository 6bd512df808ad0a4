"""Best-fit packing: combinations that fill a sequence exactly are found by hashing length sums, the rest is best fit.

1. Documents become token ids and are cut into pieces of at most ``capacity`` (only longer ones are cut).
2. The histogram of lengths, at most ``capacity`` numbers, is planned on the driver. The longest length left is completed by one, two or three
   lengths whose sum is exactly the gap, looked up by their sums under availability counts; where none exists, the longest that
   fits goes in and the smaller gap is tried again. A pattern is repeated until one of its lengths runs out, so there are no more
   patterns than lengths.
3. A piece's rank among the pieces of its length picks its pattern, repetition and place. Ranks are counted in salted
   parts, so a length shared by a third of all pieces is ranked by many tasks.

The plan that tasks receive is bounded by ``capacity``, not by the data.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from hitfold.llm.common import column_of, documents, sliced, written
from hitfold.llm.tokens import encoder

CAPACITY, END_ID = 4096, 1
SALTS = 128


# --- the plan ------------------------------------------------------------------------------------


def exact_fill(have: np.ndarray, gap: int) -> list[int] | None:
    """One, two or three available lengths with the sum ``gap``, the longest first; None if there are none."""
    if gap and have[gap]:
        return [gap]
    open_ = have > 0
    lengths = np.flatnonzero(open_[: gap + 1])[::-1]

    def pair(total: int, most: int, taken: int) -> list[int] | None:
        a = lengths[(lengths <= min(most, total - 1)) & (lengths * 2 >= total)]
        b = total - a
        left = have[b] - (b == taken) - (b == a)
        fits = (left > 0) & (have[a] - (a == taken) > 0)
        if fits.any():
            i = int(np.argmax(fits))
            return [int(a[i]), int(b[i])]
        return None

    if found := pair(gap, gap, 0):
        return found
    for first in lengths[(lengths * 3 >= gap) & (lengths <= gap - 2)].tolist():
        if found := pair(gap - first, first, first):
            return [first, *found]
    return None


def plan(counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Patterns (lengths, repetitions) that use up ``counts`` (pieces by length, from 0 to ``capacity``)."""
    have, patterns = counts.astype(np.int64).copy(), []
    for longest in range(capacity, 0, -1):
        while have[longest]:
            pattern, gap = [longest], capacity - longest
            have[longest] -= 1
            while gap:
                found = exact_fill(have, gap)
                if found is None:
                    fitting = np.flatnonzero(have[: gap + 1])
                    if not len(fitting):
                        break
                    found = [int(fitting[-1])]
                for x in found:
                    have[x] -= 1
                    gap -= x
                pattern += found
            lengths, uses = np.unique(pattern, return_counts=True)
            more = int((have[lengths] // uses).min())
            have[lengths] -= more * uses
            patterns.append((pattern, more + 1))
    return patterns


def places(patterns: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """Sorted runs of ranks: those of ``length`` from ``rank`` on go to sequences from ``sequence`` on, at ``offset``."""
    used: dict[int, int] = {}
    rows, base = [], 0
    for lengths, times in patterns:
        offset = 0
        for x in lengths:
            rows.append((x, used.get(x, 0), base, offset))
            used[x] = used.get(x, 0) + times
            offset += x
        base += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return {name: table[:, i] for i, name in enumerate(("length", "rank", "sequence", "offset"))}


def best_fit(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces (doc_id, piece, length and any other columns).

    Lengths must be from 1 to ``capacity``. Equal lengths are ranked by a hash of doc_id and piece, then by these. The input is
    read three times, so it should be a written table.
    """
    salted = pieces.withColumn("__llm_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS)).cast("int"))
    parts = written(salted.groupBy("length", "__llm_salt").agg(F.count(F.lit(1)).alias("__llm_m")), "lengths")
    counts = np.zeros(capacity + 1, np.int64)
    for row in parts.groupBy("length").agg(F.sum("__llm_m").alias("n")).collect():  # at most ``capacity`` rows
        counts[row["length"]] = row["n"]
    runs = pieces.sparkSession.sparkContext.broadcast(places(plan(counts, capacity)))
    upto = Window.partitionBy("length").orderBy("__llm_salt").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("length", "__llm_salt").orderBy(F.xxhash64(F.lit(1), "doc_id", "piece"), "doc_id", "piece")
    ranked = (
        salted.join(parts.withColumn("__llm_before", F.coalesce(F.sum("__llm_m").over(upto), F.lit(0))).drop("__llm_m"), ["length", "__llm_salt"])
        .withColumn("__llm_rank", F.col("__llm_before") + F.row_number().over(inside) - 1)
        .select(*pieces.columns, "__llm_rank")
    )
    schema = T.StructType([*pieces.schema, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    names = pieces.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = runs.value
        keys = (table["length"] << 48) | table["rank"]
        for batch in batches:
            rank = column_of(batch, "__llm_rank").to_numpy()
            at = np.searchsorted(keys, (column_of(batch, "length").to_numpy().astype(np.int64) << 48) | rank, "right") - 1
            columns = [column_of(batch, n) for n in names]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(table["sequence"][at] + rank - table["rank"][at]), pa.array(table["offset"][at])],
                [*names, "sequence_id", "offset"],
            )

    return ranked.mapInArrow(place, schema)


# --- documents -----------------------------------------------------------------------------------


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Token pieces of every text: (doc_id, piece, start, length, ids_crc32), and ``ids`` (little-endian 32 bits) on demand.

    A null or empty text has the end id alone. Only documents above ``capacity`` are cut; their last piece may be shorter.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokens = encoder(tokenizer)
        end = np.array([end_id], "<u4")
        for batch in sliced(batches):
            rows = []
            for doc_id, text in zip(column_of(batch, "doc_id").to_pylist(), column_of(batch, "text").to_pylist(), strict=True):
                ids = np.concatenate([np.frombuffer(tokens.encode(text), tokens.kind).astype("<u4"), end])
                for k, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity].tobytes()
                    rows.append((doc_id, k, start, len(part) // 4, crc32(part), part if with_ids else None))
            ids_, piece, start, length, check, blob = zip(*rows, strict=True)
            columns = [pa.array(ids_, pa.int64()), pa.array(piece, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, check)]]
            columns += [pa.array(blob, pa.binary())] if with_ids else []
            yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, schema)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with ``sequence_id`` and ``offset``: each sequence is filled from 0 without gaps.

    Rows that repeat a doc_id, or have none, are documents of their own. Columns other than doc_id and text aren't read. An empty table
    gives no rows.
    """
    return best_fit(written(pieces(docs, tokenizer, capacity, end_id, with_ids), "pieces"), capacity)


def op1_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    import public_tokenizers

    return pack(documents(spark, sf_dir, "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
