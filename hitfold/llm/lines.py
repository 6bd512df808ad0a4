"""Line dedup: a sharded minimal perfect hash over the hashes of repeated lines, probed by documents.

A line's key is the line with ``[\\x20\\x09-\\x0D]`` stripped from both ends and A-Z lower-cased. Two independent
64-bit hashes stand for a key: the first places it, the second is its fingerprint.

1. One pass over the texts gives a row per document and distinct long key; they are counted (partly before the shuffle).
2. Keys found often enough are dealt into shards of about ``SHARD_KEYS``. Each shard gets a minimal
   perfect hash (cascaded bit arrays) and, at its slots, arrays of fingerprints, document counts and last documents.
3. The rows of step 1 meet the arrays shard by shard, in a sorted stream: a task holds one shard and one batch. Shards are
   replicated over ``SALTS`` parts so that a line held by a third of all documents is probed by many tasks.
4. Each document gets its list of keys to lose and is cut once.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hitfold.llm.common import column_of, documents, mix, written

MIN_CHARS, MIN_DOCUMENTS = 20, 3
SHARD_KEYS, SALTS = 1 << 14, 16
_STRIP = b" \t\n\x0b\x0c\r"


def key_of(line: bytes) -> bytes:
    return line.strip(_STRIP).lower()  # bytes.lower() touches A-Z only


def long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (key.isascii() or len(key.decode()) >= least)


def key_hash(key: bytes) -> bytes:
    return blake2b(key, digest_size=16).digest()


# --- minimal perfect hash ------------------------------------------------------------------------


class PerfectHash:
    """Cascade of bit arrays: a key lives in the first level where no other remaining key shares its place."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels, self.ranks, base = levels, [], 0
        for bits in levels:
            ranks = np.cumsum(bits, dtype=np.int64) - bits + base
            self.ranks.append(ranks)
            base += int(bits.sum())
        self.size = base

    @staticmethod
    def place(first: np.ndarray, second: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(first + np.uint64(level) * (second | np.uint64(1))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, first: np.ndarray, second: np.ndarray) -> PerfectHash:
        levels: list[np.ndarray] = []
        while len(first):
            size = 2 * len(first) + 1
            at = cls.place(first, second, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone.astype(np.uint8))
            rest = ~alone[at]
            first, second = first[rest], second[rest]
        return cls(levels)

    def slots(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 or any slot for keys that were not built in."""
        out = np.full(len(first), -1, np.int64)
        left = np.arange(len(first))
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            if not len(left):
                break
            at = self.place(first[left], second[left], level, len(bits))
            here = bits[at] == 1
            out[left[here]] = ranks[at[here]]
            left = left[~here]
        return out

    def to_bytes(self) -> bytes:
        sizes = np.array([len(self.levels), *map(len, self.levels)], "<i8")
        return sizes.tobytes() + b"".join(np.packbits(x).tobytes() for x in self.levels)

    @classmethod
    def from_bytes(cls, blob: bytes) -> PerfectHash:
        n = int(np.frombuffer(blob, "<i8", 1)[0])
        sizes, at, levels = np.frombuffer(blob, "<i8", n, 8), 8 * (n + 1), []
        for size in sizes.tolist():
            levels.append(np.unpackbits(np.frombuffer(blob, np.uint8, (size + 7) // 8, at), count=size))
            at += (size + 7) // 8
        return cls(levels)


# --- the steps -----------------------------------------------------------------------------------


def line_keys(docs: DataFrame, least: int) -> DataFrame:
    """A row per document and distinct key of at least ``least`` code points: (h1, h2, doc_id)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, owners = [], []
            for doc_id, text in zip(column_of(batch, "doc_id").to_pylist(), column_of(batch, "text").cast(pa.binary()).to_pylist(), strict=True):
                keys = {key_of(x) for x in text.split(b"\n")} if text else ()
                found = [key_hash(k) for k in keys if long_enough(k, least)]
                hashes += found
                owners += [doc_id] * len(found)
            pair = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(owners, pa.int64())], ["h1", "h2", "doc_id"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, "h1 long, h2 long, doc_id long")


def build_shards(entries: DataFrame, shards: int) -> DataFrame:
    """(h1, h2, found, keep) into one row a shard: perfect hash, fingerprints, counts and last documents as arrays."""

    def build(key, table):
        first, second = (table.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))
        index = PerfectHash.build(first, second)
        order = np.argsort(index.slots(first, second))
        columns = [table.column(c).to_numpy()[order] for c in ("h2", "found", "keep")]
        return pa.table(
            [[key[0].as_py()], [index.to_bytes()], *[[c.astype("<i8").tobytes()] for c in columns]],
            schema=pa.schema([("shard", pa.int32()), ("hash", pa.binary()), ("prints", pa.binary()), ("found", pa.binary()), ("keep", pa.binary())]),
        )

    return (
        entries.withColumn("shard", shard_of(shards))
        .groupBy("shard")
        .applyInArrow(build, "shard int, hash binary, prints binary, found binary, keep binary")
    )


def shard_of(shards: int):
    return F.pmod(F.col("h1"), F.lit(shards)).cast("int")


def probe(keys: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """(doc_id, h1) of each key that its document must lose: it is indexed and a later document keeps it."""
    salted = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).select(
        "shard", "salt", F.lit(0).alias("kind"), "hash", "prints", "keep", *[F.lit(None).cast("long").alias(c) for c in ("h1", "h2", "doc_id")]
    )
    asked = keys.select(
        shard_of(shards).alias("shard"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"), F.lit(1).alias("kind"),
        *[F.lit(None).cast("binary").alias(c) for c in ("hash", "prints", "keep")], "h1", "h2", "doc_id",
    )

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held = None, None
        for batch in batches:
            shard, salt, kind, h1, h2, doc = (
                column_of(batch, c).fill_null(-1).to_numpy(zero_copy_only=False) for c in ("shard", "salt", "kind", "h1", "h2", "doc_id")
            )
            place = shard.astype(np.int64) * SALTS + salt
            cuts = np.flatnonzero((np.diff(place, prepend=-1) != 0) | (kind == 0)).tolist()
            edges = sorted({0, *cuts, *(c + 1 for c in cuts if kind[c] == 0), len(place)})
            docs, lost = [], []
            for a, b in zip(edges, edges[1:], strict=False):
                if kind[a] == 0:
                    blobs = [column_of(batch, c)[a].as_py() for c in ("hash", "prints", "keep")]
                    here, held = place[a], (PerfectHash.from_bytes(blobs[0]), *(np.frombuffer(x, "<i8") for x in blobs[1:]))
                elif here == place[a]:
                    index, prints, keep = held
                    slot = index.slots(h1[a:b].view(np.uint64), h2[a:b].view(np.uint64))
                    gone = (slot >= 0) & (prints[slot] == h2[a:b]) & (doc[a:b] < keep[slot])
                    docs.append(doc[a:b][gone])
                    lost.append(h1[a:b][gone])
            if docs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(docs)), pa.array(np.concatenate(lost))], ["doc_id", "h1"])

    parts = max(int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return (
        salted.unionByName(asked)
        .repartition(parts, "shard", "salt")
        .sortWithinPartitions("shard", "salt", "kind")
        .mapInArrow(answer, "doc_id long, h1 long")
    )


def drop_lines(docs: DataFrame, least: int = MIN_CHARS, documents: int = MIN_DOCUMENTS) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``, plus ``n_lines`` (before) and ``n_dropped``.

    A key of at least ``least`` code points found in at least ``documents`` rows loses all its lines except in rows with
    the largest doc_id that holds it. Lines split at \\n; a null or empty text is one empty line, and null stays null.
    Rows that repeat a doc_id count as documents each and are cut alike; a row without doc_id counts, and its lines are never the
    last ones. Other columns pass through; columns named n_lines or n_dropped are replaced. An empty table gives no rows.
    """
    keys = written(line_keys(docs, least), "line-keys")
    entries = written(
        keys.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("found"), F.coalesce(F.max("doc_id"), F.lit(-1)).alias("keep"))
        .filter(F.col("found") >= documents),
        "lines",
    )
    shards = entries.count() // SHARD_KEYS + 1
    index = written(build_shards(entries, shards), "line-index")
    lost = probe(keys.withColumn("doc_id", F.coalesce("doc_id", F.lit(-(1 << 62)))), index, shards).groupBy("doc_id").agg(F.collect_list("h1").alias("__llm_lost"))
    docs = docs.drop("n_lines", "n_dropped")
    schema = T.StructType([*docs.schema, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    names = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, before, dropped = [], [], []
            for text, lost in zip(column_of(batch, "text").cast(pa.binary()).to_pylist(), column_of(batch, "__llm_lost").to_pylist(), strict=True):
                lines = (text or b"").split(b"\n")
                before.append(len(lines))
                if lost:
                    gone = set(lost)
                    stay = [x for x in lines if not (long_enough(k := key_of(x), least) and int.from_bytes(key_hash(k)[:8], "little", signed=True) in gone)]
                    dropped.append(len(lines) - len(stay))
                    text = b"\n".join(stay)
                else:
                    dropped.append(0)
                kept.append(text)
            columns = [pa.array(kept, pa.binary()).cast(pa.string()) if n == "text" else column_of(batch, n) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(before, pa.int64()), pa.array(dropped, pa.int64())], [*names, "n_lines", "n_dropped"])

    joined = docs.withColumn("__llm_key", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 62)))).join(
        lost.withColumnRenamed("doc_id", "__llm_key"), "__llm_key", "left"
    )
    return joined.select(*names, "__llm_lost").mapInArrow(cut, schema)


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Lines and dropped lines of every document, and the digest of what stays."""
    kept = drop_lines(documents(spark, sf_dir, "doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


ORACLE = {
    "op3_line_dedup": """
WITH lines AS (
  SELECT doc_id, i, list_extract(parts, i) AS line FROM (
    SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))
), keyed AS (
  SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), often AS (
  SELECT k, max(doc_id) AS keep FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT doc_id, i, line, often.k IS NOT NULL AND doc_id < keep AS gone FROM keyed LEFT JOIN often USING (k)
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
}
